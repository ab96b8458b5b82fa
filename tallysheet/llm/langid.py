"""Language identification: known words by their frequency in each language, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.common import columns, kept_by_worker

TOKEN = re.compile(r"[^\W\d_]+")
ORDERS = (3, 2, 1)
UNKNOWN = "und"
#: Documents that a worker takes at once, and words whose scores it holds at once.
SLICE, AT_ONCE = 1000, 50_000


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters; what `re` counts as a letter but isn't one (such as a raised two) is cut away."""
    found = TOKEN.findall(text.lower())
    if text.isascii():
        return found
    return [w for w in found if w.isalpha()] if all(map(str.isalpha, found)) else [w for x in found for w in re.split(r"[^\w]", "".join(c if c.isalpha() else " " for c in x)) if w]


@dataclass
class Model:
    """Log frequencies (a row for each word or n-gram, a column for each language), by sorted keys: 64-bit hashes of words, packed letters of n-grams."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    keys: dict[int, np.ndarray]
    gram_scores: dict[int, np.ndarray]
    floor: np.ndarray
    prior: np.ndarray

    def unseen(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words. At each letter stands the longest known n-gram that ends there; shorter ones cost `floor` for each step back."""
        text = "".join(f" {w}" for w in words) + " "
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        spaces = np.flatnonzero(codes == 32)
        starts, ends = spaces[:-1] + 1, spaces[1:]
        n = len(codes)
        scores, left = np.zeros((n, len(self.languages))), codes != 32
        left[ends] = True  # the word's end counts, its start is context only
        left[0] = False
        begin = np.zeros(n, np.int64)
        begin[starts] = starts - 1
        begin = np.maximum.accumulate(begin)
        begin[ends] = starts - 1
        for step, order in enumerate(ORDERS):
            key = codes.copy()
            for back in range(1, order):
                key[back:] |= codes[:-back] << (21 * back)
            at = np.flatnonzero(left & (np.arange(n) - (order - 1) >= begin))
            if not len(at) or not len(self.keys[order]):
                continue
            i = np.minimum(np.searchsorted(self.keys[order], key[at]), len(self.keys[order]) - 1)
            hit = self.keys[order][i] == key[at]
            scores[at[hit]] = self.gram_scores[order][i[hit]] + step * self.floor
            left[at[hit]] = False
        scores[left & (codes != 32)] = self.floor * (len(ORDERS) + 1)
        # Words are separated by single spaces; each word's letters and its closing space are its own.
        return np.add.reduceat(scores, starts, axis=0)[: len(words)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        totals = np.tile(self.prior, (len(texts), 1))
        some, pending, owner, begins = np.zeros(len(texts), bool), [], [], []
        for d, text in enumerate(texts):
            tokens = letters(text or "")
            if not tokens:
                continue
            some[d] = True
            owner.append(d)
            begins.append(len(pending))
            pending += tokens
            if len(pending) > AT_ONCE:
                totals[owner] += np.add.reduceat(self.scores(pending), begins, axis=0)
                pending, owner, begins = [], [], []
        if pending:
            totals[owner] += np.add.reduceat(self.scores(pending), begins, axis=0)
        best = totals.argmax(axis=1)
        odds = np.exp(totals - totals.max(axis=1, keepdims=True))
        score = odds.max(axis=1) / odds.sum(axis=1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], [float(p) if s else 0.0 for p, s in zip(score, some, strict=True)]

    def scores(self, tokens: list[str]) -> np.ndarray:
        """A row for each token: a known word's log frequencies, else what its n-grams say."""
        h = word_keys(tokens)
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        known = self.words[at] == h if len(self.words) else np.zeros(len(h), bool)
        out = np.zeros((len(tokens), len(self.languages)))
        out[known] = self.word_scores[at[known]]
        rare = np.flatnonzero(~known)
        if len(rare):
            out[rare] = self.unseen([tokens[i] for i in rare.tolist()])
        return out


def word_keys(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def gram_key(gram: str) -> int:
    """Up to three letters of 21 bits each."""
    key = 0
    for c in gram:
        key = key << 21 | ord(c)
    return key


def counts(rows: DataFrame) -> DataFrame:
    """(lang, kind, key, n): words (kind 0) and n-grams (their order) of a (lang, text) table, by key; each task combines its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language")
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            seen: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(letters(text.as_py() or ""))
            for lang, found in seen.items():
                grams: dict[int, Counter] = {order: Counter() for order in ORDERS}
                for w, n in found.items():
                    x = f" {w} "
                    for i in range(1, len(x)):
                        for order in ORDERS:
                            if i - order + 1 >= 0:
                                grams[order][x[i - order + 1 : i + 1]] += n
                for kind, of in ((0, found), *grams.items()):
                    keys = word_keys(list(of)) if kind == 0 else np.fromiter(map(gram_key, of), np.int64, len(of))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(of), pa.string()), pa.array(np.full(len(of), kind, np.int32)), pa.array(keys), pa.array(list(of.values()), pa.int64())], ["lang", "kind", "key", "n"])

    return rows.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_by: str = "doc_id", max_docs: int = 4000, smoothing: float = 0.5, seed: int = 3) -> Model:
    """A model from labelled rows: at most about max_docs documents of each language (those of least hash), and all of their words and n-grams."""
    docs = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(order_by).alias("_id"))
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled rows to learn from")
    rate = F.coalesce(*[F.when(F.col("lang") == k, min(1.0, max_docs / n)) for k, n in sizes.items()])
    unit = F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    languages = sorted(sizes)
    column = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    found = counts(docs.filter(unit < rate).select("lang", "text")).select(column.alias("lang"), "kind", "key", "n").toArrow()
    langs, kinds, all_keys, n = (found[c].to_numpy() for c in ("lang", "kind", "key", "n"))
    scores, keys = {}, {}
    for kind in (0, *ORDERS):
        own = kinds == kind
        keys[kind], at = np.unique(all_keys[own], return_inverse=True)
        table = np.zeros((len(keys[kind]), len(languages)))
        table[at, langs[own]] = n[own]
        scores[kind] = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * (len(table) + 1))).astype(np.float32)
    share = np.array([sizes[x] for x in languages], float)
    return Model(languages, keys.pop(0), scores.pop(0), keys, scores, np.full(len(languages), -1.0), np.log(share / share.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the language's probability) added; `und` and 0 where text is null or has no letter.

    Other columns stay; columns named like an added one are replaced. Repeated rows give repeated rows; of languages that are
    as likely, the first by name is taken. No shuffle: the model is a broadcast as large as its bounded training rows make it.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = columns(docs, *keep)
    at, shared = keep.index(text_col), docs.sparkSession.sparkContext.broadcast(model)
    schema = type(docs.schema)([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("language")
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                b = whole.slice(i, SLICE)
                names, scores = shared.value.predict(b.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """docs with lang_pred and score added, by a model of labelled (docs itself where that is None).

    Without one labelled row every text is `und` with score 0. A null or letterless text is `und`. See predict and fit.
    """
    try:
        model = fit(docs if labelled is None else labelled, text_col, lang_col, id_col, **fitting)
    except ValueError:
        keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
        return columns(docs, *keep).withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    return predict(docs, model, text_col)
