"""Brown class-based n-grams: words in classes by exchange clustering, and documents scored by transitions and emissions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.blocks import BLOCK_CHARS, pack_numbers, unpack_numbers, unpack_parts, whole_blocks
from tallysheet.llm.common import columns, kept_by_worker, released, staged, words_of

END = b""
#: Words that one step of a shard's sweep holds context counts of.
AT_ONCE = 20_000


def tokens(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case, and one end."""
    return [*words_of(text), END]


def in_fold(doc_id: int | None, folds: int = 7, fold: int = 2) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 6) -> np.ndarray:
    """The class of each unit: each is moved to where the likelihood of the class bigrams grows most, until a sweep moves none.

    Start: units by falling frequency, dealt round.
    """
    n = len(bigrams)
    freq = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-freq, kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n) % classes
    hot = np.zeros((n, classes))
    hot[np.arange(n), of] = 1
    table = hot.T @ bigrams @ hot
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not freq[w]:
                break
            out, into, own, was = bigrams[w] @ hot, bigrams[:, w] @ hot, bigrams[w, w], of[w]
            out[was] -= own
            into[was] -= own
            hot[w, was] = 0
            table[was] -= out
            table[:, was] -= into
            table[was, was] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (_f(table + out) - _f(table)).sum(axis=1) + (_f(table + into[:, None]) - _f(table)).sum(axis=0)
            d = np.diag(table)
            gain += _f(d + out + into + own) - _f(d + out) - _f(d + into) + _f(d)
            gain -= _f(rows + out.sum() + own) - _f(rows) + _f(cols + into.sum() + own) - _f(cols)
            best = int(gain.argmax())
            if gain[best] <= gain[was] + 1e-9:
                best = was
            moved += best != was
            of[w] = best
            hot[w, best] = 1
            table[best] += out
            table[:, best] += into
            table[best, best] += own
        if not moved:
            break
    return of


def class_scores(table: np.ndarray, smoothing: float = 0.5) -> np.ndarray:
    """What each known neighbour says of a word's class, as log-likelihood: a row for each class before it, then for each class after it; a column for each class of the word."""
    k = len(table)
    before = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * k))
    after = np.log((table.T + smoothing) / (table.sum(axis=1) + smoothing * k))
    return np.concatenate([before, after])


def best_classes(contexts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word by its context counts (classes before, then classes after): that of the largest likelihood under the class bigrams; the larger class where that is equal.

    Rounded, so that it doesn't depend on how many words are multiplied at once.
    """
    share = np.log((table.sum(axis=0) + 1) / (table.sum() + len(table)))
    return np.round(contexts @ class_scores(table) + 1e-3 * share, 6).argmax(axis=1)


class Places:
    """A staged block's tokens: the rank of each token's word in the order of shards, and of the words before and after it (an end stands before the first word and after the end)."""

    def __init__(self, lengths: np.ndarray, numbers: bytes, shards: bytes) -> None:
        own = unpack_numbers(shards)
        order = np.argsort(own, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.size, self.at = len(order), rank[unpack_numbers(numbers)]
        self.found, self.starts = np.unique(own[order], return_index=True)
        self.lengths = lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths

    def before(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate([x[:1], x[:-1]])
        out[self.begins] = x[self.ends - 1]
        return out

    def after(self, x: np.ndarray) -> np.ndarray:
        out = np.concatenate([x[1:], x[:1]])
        out[self.ends - 1] = x[self.begins]
        return out

    def training(self, doc_ids: list, train: Callable[[int | None], bool]) -> np.ndarray:
        return np.repeat(np.fromiter(map(train, doc_ids), bool, len(doc_ids)), self.lengths)


class Known(dict):
    """word -> place in the table of frequent words, and the class at each place."""

    def __init__(self, words: list[bytes], classes: np.ndarray, fixed: int) -> None:
        super().__init__(zip(words, range(len(words)), strict=True))
        self.classes, self.fixed = np.append(classes, -1), fixed

    def __reduce__(self):
        return Known, (list(self), self.classes[:-1], self.fixed)

    def places(self, words: list[bytes]) -> np.ndarray:
        """-1: not in the table."""
        return np.fromiter((self.get(w, -1) for w in words), np.int64, len(words))


def word_counts(blocks: DataFrame, train: Callable[[int | None], bool], partitions: int) -> DataFrame:
    """(word, c): the training tokens of each word that has one, from blocks' words by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("brown")
        for b in batches:
            for ids, lengths, numbers, shards, parts in zip(*(b.column(i) for i in range(5)), strict=True):
                p = Places(lengths.values.to_numpy(), numbers.as_py(), shards.as_py())
                n = np.bincount(p.at[p.training(ids.as_py(), train)], minlength=p.size)
                ends = np.append(p.starts[1:], p.size)
                rows = [(x["shard"], x["words"], pack_numbers(n[i:j])) for x, i, j in zip(parts.as_py(), p.starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "words", "n"])

    def total(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for _, words, n in rows:
            for w, x in zip(unpack_parts(words), unpack_numbers(n).tolist(), strict=True):
                if x:
                    seen[w] = seen.get(w, 0) + x
        words = list(seen)
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "c"])

    rows = blocks.select("doc_ids", "lengths", "numbers", "shards", "parts").mapInArrow(count, "shard int, words binary, n binary")
    return rows.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(total), "word binary, c long")


def _by_shard(of: Callable[[list[tuple]], Iterator[pa.RecordBatch]]) -> Callable:
    """of(the rows of one shard) for each shard of a task's rows, which are sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("brown")
        at, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != at and rows:
                    yield from of(rows)
                    rows = []
                at = row[0]
                rows.append(row)
        if rows:
            yield from of(rows)

    return run


def core_bigrams(blocks: DataFrame, words, size: int, train: Callable[[int | None], bool]) -> np.ndarray:
    """How often each of the `size` words follows each, over all training texts. At most size * size counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = words.value, np.zeros(size * size, np.int64)
        for b in batches:
            for ids, lengths, numbers, shards, parts in zip(*(b.column(i) for i in range(5)), strict=True):
                p = Places(lengths.values.to_numpy(), numbers.as_py(), shards.as_py())
                x = known.places([w for part in parts.as_py() for w in unpack_parts(part["words"])])[p.at]
                was = p.before(x)
                ok = (x >= 0) & (was >= 0) & p.training(ids.as_py(), train)
                total += np.bincount(was[ok] * size + x[ok], minlength=size * size)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 200_000):
            part = at[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["pair", "n"])

    got = blocks.select("doc_ids", "lengths", "numbers", "shards", "parts").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(size, size)


SWEPT = "block long, shard int, words binary, sums array<double>, tops array<int>, classes array<int>"


def sweep(blocks: DataFrame, known, tops, table: np.ndarray, train: Callable[[int | None], bool], partitions: int, listed: bool, classed: DataFrame | None = None) -> DataFrame:
    """One sweep of exchange over all words: each training word goes to the best class for its neighbours of known class.

    A block gives, for each of its words, the number of its training tokens and how often classes of `known` stand before and after
    it; these meet by shard of the word's hash. A row without block for each shard: sums has the class bigrams
    (of which one word at least is known), then the tokens and the once-seen words of each class; tops and classes have the
    places in `tops` of its words, and their classes. With listed, also a row for each block and shard: the counts and classes of the block's words.
    With classed, the listed rows of the sweep before, every training word is known, by its class there.
    """
    k, everywhere = len(table), classed is not None

    def told(block: int, ids: list, p: Places, parts: list, g: np.ndarray) -> pa.RecordBatch:
        """g: the class of each token, -1 if it isn't known."""
        use = p.training(ids, train)
        n = np.bincount(p.at[use], minlength=p.size)
        keys = []
        for side, near in ((0, p.before(g)), (k, p.after(g))):
            ok = use & (near >= 0)
            keys.append(p.at[ok] * (2 * k) + side + near[ok])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        m = np.bincount(key // (2 * k), minlength=p.size)
        starts, ends = p.starts, np.append(p.starts[1:], p.size)
        upto = np.concatenate([[0], np.cumsum(m)])
        rows = [(x["shard"], block, x["words"], pack_numbers(np.concatenate([n[i:j], m[i:j], key[upto[i] : upto[j]] % (2 * k), count[upto[i] : upto[j]]]))) for x, i, j in zip(parts, starts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "block", "words", "stats"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("brown")
        for b in batches:
            for block, ids, lengths, numbers, shards, parts in zip(*(b.column(i) for i in range(6)), strict=True):
                p, parts = Places(lengths.values.to_numpy(), numbers.as_py(), shards.as_py()), parts.as_py()
                g = known.value.classes[known.value.places([w for part in parts for w in unpack_parts(part["words"])])][p.at]
                yield told(block.as_py(), ids.as_py(), p, parts, g)

    def classed_contexts(v: pa.Table, b: pa.Table) -> pa.Table:
        kept_by_worker("brown")
        p = Places(b["lengths"][0].values.to_numpy(), b["numbers"][0].as_py(), b["shards"][0].as_py())
        _, g = counts_and_classes(v, p)
        return pa.Table.from_batches([told(b["block"][0].as_py(), b["doc_ids"][0].as_py(), p, b["parts"][0].as_py(), g)])

    def assign(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        at, counts, flat, weight = [], [], [], []
        for _, _, words, stats in rows:
            its, x = unpack_parts(words), unpack_numbers(stats).astype(np.int64)
            own = np.fromiter((seen.setdefault(w, len(seen)) for w in its), np.int64, len(its))
            n, m, rest = x[: len(own)], x[len(own) : 2 * len(own)], x[2 * len(own) :]
            at.append(own)
            counts.append(n)
            flat.append(np.repeat(own, m) * (2 * k) + rest[: len(rest) // 2])
            weight.append(rest[len(rest) // 2 :])
        words = list(seen)
        c = np.bincount(np.concatenate(at), np.concatenate(counts), len(words)).astype(np.int64)
        flat, weight = np.concatenate(flat), np.concatenate(weight)
        order = np.argsort(flat, kind="stable")
        flat, weight = flat[order], weight[order]
        place, g, sums = known.value.places(words), np.zeros(len(words), np.int64), np.zeros((k, k))
        for i in range(0, len(words), AT_ONCE):
            j = min(len(words), i + AT_ONCE)
            lo, hi = np.searchsorted(flat, [i * 2 * k, j * 2 * k])
            near = np.bincount(flat[lo:hi] - i * 2 * k, weight[lo:hi], (j - i) * 2 * k).reshape(j - i, 2 * k)
            fixed = (place[i:j] >= 0) & (place[i:j] < known.value.fixed)
            g[i:j] = np.where(fixed, known.value.classes[place[i:j]], best_classes(near, table))
            hot = np.zeros((j - i, k))
            hot[np.arange(j - i), g[i:j]] = 1
            # A bigram of two known words counts once, as what stands before the second.
            new = (place[i:j] < 0) & (not everywhere)
            sums += near[:, :k].T @ hot + hot[new].T @ near[new, k:]
        emitted, once = np.bincount(g, c, k), np.bincount(g, c == 1, k)
        top = tops.value.places(words)
        t = np.flatnonzero(top >= 0)
        shard = rows[0][0]
        yield _swept([(None, shard, None, np.concatenate([sums.ravel(), emitted, once]), top[t], g[t])])
        if listed:
            for own, (_, block, _, _) in zip(at, rows, strict=True):
                yield _swept([(block, shard, pack_numbers(np.concatenate([c[own], g[own]])), None, None, None)])

    form = "shard int, block long, words binary, stats binary"
    if classed is None:
        rows = blocks.select("block", "doc_ids", "lengths", "numbers", "shards", "parts").mapInArrow(contexts, form)
    else:
        values, places = per_block(classed, blocks, "parts")
        rows = values.cogroup(places).applyInArrow(classed_contexts, form)
    return rows.repartition(partitions, "shard").sortWithinPartitions("shard").mapInArrow(_by_shard(assign), SWEPT)


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "shard", "words", "sums", "tops", "classes"])


def counts_and_classes(v: pa.Table, p: Places) -> np.ndarray:
    """The training counts and the classes of a block's tokens, from its rows of a last sweep."""
    pairs = [unpack_numbers(x.as_py()).astype(np.int64).reshape(2, -1) for x in v.sort_by("shard")["words"]]
    return np.concatenate(pairs, axis=1)[:, p.at]


def class_bigrams(swept: DataFrame, blocks: DataFrame, k: int, train: Callable[[int | None], bool]) -> np.ndarray:
    """How often each class follows each, over all training tokens, with the classes of a last sweep. k * k numbers reach the driver."""

    def run(v: pa.Table, b: pa.Table) -> pa.Table:
        p = Places(b["lengths"][0].values.to_numpy(), b["numbers"][0].as_py(), b["shards"][0].as_py())
        _, g = counts_and_classes(v, p)
        use = p.training(b["doc_ids"][0].as_py(), train)
        n = np.bincount(p.before(g)[use] * k + g[use], minlength=k * k)
        at = np.flatnonzero(n)
        return pa.table({"at": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    values, places = per_block(swept, blocks)
    got = values.cogroup(places).applyInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(k, k)


def per_block(swept: DataFrame, blocks: DataFrame, *more: str):
    values = swept.filter("block is not null").select("block", "shard", "words")
    return values.groupBy("block"), blocks.select("block", "doc_ids", "lengths", "numbers", "shards", *more).groupBy("block")


@dataclass
class Model:
    transitions: np.ndarray  # P(class | class before)
    emitted: np.ndarray  # tokens of each class
    once: np.ndarray  # words of each class that stand once, the estimate of its unknown ones
    end: int  # the class of the end
    n: int
    v: int
    weight: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 1) / (self.n + self.v + 1)

    def probabilities(self, c: np.ndarray, g: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of tokens with training counts c and classes g after tokens of classes `before`."""
        weight = self.weight if self.n else 0.0
        room = np.maximum(self.emitted + self.once, 1)
        unknown = self.transitions @ (self.once / room)
        own = np.where(c > 0, self.transitions[before, g] * c / room[g], unknown[before])
        return weight * own + (1 - weight) * self.base(c)


def fit(blocks: DataFrame, train: Callable[[int | None], bool], partitions: int, core: int, known_words: int | None, classes: int, sweeps: int, weight: float, smoothing: float = 0.1) -> tuple[Model, DataFrame, list[str]]:
    """The model, the last sweep's rows (with the count and class of each word of each block), and their staged path.

    1. The `core` most frequent words and the end are clustered by exact exchange over their bigrams.
    2. In each sweep, every other word of the training text goes to its best class, by its neighbours of known class: those of the core at first, then all
       (with known_words: so many of the most frequent words), with the classes that the sweep before gave them. The class bigrams are
       rebuilt from the contexts of all words: known neighbours count at the class they had when the sweep began.
    3. The transitions are of the class bigrams of all training tokens, with the classes of the last sweep.
    """
    spark = blocks.sparkSession
    counts, counts_path = staged(word_counts(blocks, train, partitions), "word-counts")
    n, v = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(max(core, known_words or 0)).select("word").toArrow()["word"].to_pylist()
    released(spark, counts_path)
    words = [END, *map(bytes, top)]
    size = min(core + 1, len(words))
    share = spark.sparkContext.broadcast
    bigrams = core_bigrams(blocks, share(Known(words[:size], np.zeros(size, np.int64), size)), size, train)
    of = exchange(bigrams, classes)
    hot = np.eye(classes)[of]
    table, known = hot.T @ bigrams @ hot, share(Known(words[:size], of, size))
    tops, swept, path = share(Known(words, np.zeros(len(words), np.int64), size)), None, None
    for i in range(sweeps):
        before = path
        swept, path = staged(sweep(blocks, known, tops, table, train, partitions, known_words is None or i == sweeps - 1, swept if known_words is None else None), "sweep")
        if before:
            released(spark, before)
        summary = swept.filter("block is null")
        got = summary.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(classes * classes + 2 * classes)
        sums[got["at"].to_numpy()] = got["x"].to_numpy()
        table = sums[: classes * classes].reshape(classes, classes)
        if i < sweeps - 1 and known_words is not None:
            g = np.zeros(len(words), np.int64)
            found = summary.select(F.explode(F.arrays_zip("tops", "classes")).alias("x")).select("x.tops", "x.classes").toArrow()
            g[found["tops"].to_numpy()] = found["classes"].to_numpy()
            known = share(Known(words, g, size))
    table = class_bigrams(swept, blocks, classes, train)
    transitions = (table + smoothing) / (table.sum(axis=1, keepdims=True) + smoothing * classes)
    emitted, once = sums[classes * classes :].reshape(2, classes)
    return Model(transitions, emitted, once, int(of[0]), int(n), int(v), weight), swept, path


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Callable[[int | None], bool] = in_fold, core: int = 1000, known_words: int | None = None, classes: int = 60, sweeps: int = 2, weight: float = 0.9, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Learns from all texts of ids that held_out doesn't name; tokens are words (A-Z in lower case) and one end.
    base_score sums the log10 of (c + 1) / (N + V + 1); score that of weight * P(class | class before) * P(word | class)
    + (1 - weight) * base. A class keeps room for unknown words, as many as it has words that stand once; to an unknown word
    all classes give theirs. Both scores are proper: the words of the training text and one unknown word sum to 1.

    Every training word is in a class by its own contexts, however many words there are, see fit. What is of fixed size
    are the classes, and the core of words that exact exchange clusters on the driver. After the first sweep all words count as context: their classes come back to
    the blocks by shard. With known_words only so many of the most frequent ones do (a broadcast); others are moved like them, but tell their neighbours nothing.

    One scan splits the texts into blocks, which are staged: distinct words, and the places where they stand. Counts and contexts of words meet by shard of the
    word's hash, and shards grow with the input; a word that stands everywhere is one entry a block.

    A null text counts as empty (an end alone). With no training text all scores are 0, as c = N = V = 0.
    Repeated rows are learned and scored once each; a null id is a training row unless held_out says otherwise. Other
    columns are left out. Runs jobs while the DataFrame is being built.
    """
    spark = docs.sparkSession
    docs = columns(docs, *dict.fromkeys([id_col, text_col])).selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    train = lambda doc_id: not held_out(doc_id)
    partitions = docs.rdd.getNumPartitions()
    blocks, _ = staged(whole_blocks(docs, tokens, max(64, 4 * partitions), block_chars), "blocks")
    model, swept, _ = fit(blocks, train, max(partitions, 8), core, known_words, classes, sweeps, weight)
    shared = spark.sparkContext.broadcast(model)

    def run(v: pa.Table, b: pa.Table) -> pa.Table:
        m, doc_ids = shared.value, b["doc_ids"][0].as_py()
        p = Places(b["lengths"][0].values.to_numpy(), b["numbers"][0].as_py(), b["shards"][0].as_py())
        c, g = counts_and_classes(v, p)
        before = p.before(g)
        before[p.begins] = m.end
        base, own = np.log10(m.base(c)), np.log10(m.probabilities(c, g, before))
        n, score = p.lengths, np.add.reduceat(own, p.begins)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "held_out": pa.array([held_out(d) for d in doc_ids], pa.bool_()), "n_tokens": n, "n_known": np.add.reduceat((c > 0).astype(np.int64), p.begins), "train_tokens": np.full(len(n), m.n), "base_score": np.add.reduceat(base, p.begins), "score": score, "perplexity": 10.0 ** (-score / n)})

    values, places = per_block(swept, blocks)
    return values.cogroup(places).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
