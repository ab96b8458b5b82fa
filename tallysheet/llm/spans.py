"""Substring deduplication: sliding spans of several consecutive sentences; those that stood elsewhere before are removed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallysheet.llm.blocks import pack_numbers, unpack_numbers
from tallysheet.llm.common import columns, in_filter, kept_by_worker, staged

#: A span has so many sentences and so many words at least.
SENTENCES, WORDS = 3, 25
#: Sentences end at marks, and after one word in so many, chosen by its hash.
EVERY = 4
#: Spans that a task holds before it gives on the first of each.
HELD = 500_000

#: Powers of an odd number modulo 2**64 and of its inverse, for hashes of windows.
BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << n.bit_length())
        for name, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            _POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))])
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sentences(text: str, every: int = EVERY) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (in lower case; white space is what str.split takes for it), and the words at which sentences begin, then their number.

    A sentence ends after a word that ends with ., ! or ? (closing marks may follow), after each word whose hash is divisible by
    `every`, and after one that repeats the word before it. So long sentences, and texts without marks, have ends too,
    and those depend on these words alone: a passage has the same sentences wherever it stands, but for those that its
    first and last words share with their surroundings.
    """
    words = "\n".join(text.lower().split()).encode("utf-8", "surrogatepass")
    if not words:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.split(b"\n")), np.uint64)
    raw = np.frombuffer(words, np.uint8)
    last = np.append(np.flatnonzero(raw == 10), len(raw)) - 1
    mark, closed = raw[last], np.zeros(len(h), bool)
    for close in (b'"', b"'", b")", b"]", "»".encode(), "”".encode()):
        n = len(close)
        at = np.flatnonzero((mark == close[-1]) & (last >= n))
        closed[at[_is_mark(raw[last[at] - n])]] = True
    again = np.concatenate([[False], h[1:] == h[:-1]])
    ends = np.flatnonzero(_is_mark(mark) | closed | again | (h % np.uint64(every) == 0)) + 1
    return h, np.unique(np.concatenate([[0], ends, [len(h)]]))


def _is_mark(x: np.ndarray) -> np.ndarray:
    return (x == ord(".")) | (x == ord("!")) | (x == ord("?"))


def spans(text: str, min_words: int = WORDS, run: int = SENTENCES, every: int = EVERY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, end) of the shortest run of `run` sentences or more, with min_words words or more, from each sentence on; and where sentences begin."""
    h, begins = sentences(text, every)
    n = len(begins) - 1
    stop = np.maximum(np.arange(n) + run, np.searchsorted(begins, begins[:-1] + min_words))
    ok = stop <= n
    a, b = begins[:-1][ok], begins[stop[ok]]
    up, down = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)])
    x = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(33))).view(np.int64), a, b, begins


def settled(h: np.ndarray, d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, doc_id, first) in their order, without repeated rows, and whether a smaller row of the same hash is there."""
    order = np.lexsort((a, d, h))
    h, d, a = h[order], d[order], a[order]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    equal = np.zeros(len(h), bool)
    equal[1:] = same[1:] & (d[1:] == d[:-1]) & (a[1:] == a[:-1])
    return h[~equal], d[~equal], a[~equal], same[~equal]


def packed(h: np.ndarray, d: np.ndarray, a: np.ndarray) -> bytes:
    """Rows of spans as one string: hashes as they are, ids and places byte by byte of the same rank, compressed."""
    wide = np.ascontiguousarray(d.astype("<i8")).view("<u4")
    rest = pack_numbers(np.concatenate([wide, a.astype(np.uint32)]))
    return len(h).to_bytes(4, "little") + h.astype("<i8").tobytes() + rest


def unpacked(b: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(b[:4], "little")
    rest = unpack_numbers(b[4 + 8 * n :])
    return np.frombuffer(b[4 : 4 + 8 * n], "<i8"), np.ascontiguousarray(rest[: 2 * n]).view("<i8"), rest[2 * n :].astype(np.int64)


def span_shards(docs: DataFrame, shards: int, **rule: int) -> DataFrame:
    """(shard, later, spans): the spans of a (doc_id, text) table, dealt by hash and packed.

    Each task keeps the first of the equal ones it has read and marks the others at once, so that a span that a third of
    all documents share reaches its shard once a task; the marked ones are dealt by document.
    """

    def give(parts: list) -> pa.RecordBatch:
        h, d, a, later = settled(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        to = np.where(later, d * 0x9E3779B1, h) % shards
        key = to * 2 + later
        order = np.argsort(key, kind="stable")
        found, starts = np.unique(key[order], return_index=True)
        cuts = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array((found // 2).astype(np.int32)), pa.array(found % 2 == 1), pa.array([packed(h[i], d[i], a[i]) for i in cuts], pa.binary())], ["shard", "later", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("spans")
        parts, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, a, _, _ = spans(text.as_py() or "", **rule)
                if len(h):
                    parts.append((h, np.full(len(h), doc_id, np.int64), a))
                    held += len(h)
                if held > HELD:
                    yield give(parts)
                    parts, held = [], 0
        if parts:
            yield give(parts)

    return docs.filter("doc_id is not null").mapInArrow(run, "shard int, later boolean, spans binary")


def non_first(docs: DataFrame, shards: int, **rule: int) -> DataFrame:
    """(doc_id, spans): (hash, first) of the spans that aren't the first of their kind by doc_id, then place. One shuffle of numbers by shard, one by document."""

    def of_shard(parts: list[tuple[bool, bytes]]) -> Iterator[pa.RecordBatch]:
        joined = lambda rows: tuple(map(np.concatenate, zip(*rows, strict=True))) if rows else (np.zeros(0, np.int64),) * 3
        h, d, a, later = settled(*joined([unpacked(b) for late, b in parts if not late]))
        h, d, a = joined([(h[later], d[later], a[later]), *[unpacked(b) for late, b in parts if late]])
        order = np.lexsort((a, d))
        h, d, a = h[order], d[order], a[order]
        ids, starts = np.unique(d, return_index=True)
        ends = np.append(starts, len(d)).astype(np.int32)
        for i in range(0, len(ids), 50_000):
            j = min(len(ids), i + 50_000)
            cut, offsets = slice(ends[i], ends[j]), pa.array(ends[i : j + 1] - ends[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j]), pa.ListArray.from_arrays(offsets, pa.array(h[cut])), pa.ListArray.from_arrays(offsets, pa.array(a[cut].astype(np.int32)))], ["doc_id", "hashes", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("spans")
        at, parts = None, []
        for b in batches:
            for shard, later, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if shard != at and parts:
                    yield from of_shard(parts)
                    parts = []
                at = shard
                parts.append((later, x.as_py()))
        if parts:
            yield from of_shard(parts)

    rows = span_shards(docs, shards, **rule).repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "doc_id long, hashes array<long>, firsts array<int>")
    return rows.groupBy("doc_id").agg(F.flatten(F.collect_list("hashes")).alias("hashes"), F.flatten(F.collect_list("firsts")).alias("firsts"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = WORDS, run: int = SENTENCES, every: int = EVERY) -> DataFrame:
    """docs without the sentences that a non-first repeated span covers; n_removed (sentences) and removed_spans are added.

    A span is a run of `run` or more consecutive sentences with min_words words or more, from each sentence on; see
    sentences. Spans are equal if their words are, in lower case and without regard to white space. The first of equal
    spans (by id, then place) stays, in a document as across documents. removed_spans are the removed stretches of the text, as
    [start, end) pairs of characters; what stands between kept words is kept. A copied passage loses all but what it
    has before its first and after its last sentence end (about `every` words at most on each side).

    A null text stays null; a null id takes part in no comparison and its text stays. Rows that repeat an id are read as
    one document: they lose the same spans, and none to each other. Empty and short texts have no span. Other columns stay; those named like an added one are replaced.

    Spans meet in shards of their hash, packed, one shuffle of numbers; shards grow with the input. The result of that is staged. Texts are
    shuffled only for documents that a filter of fixed size can't rule out, to meet what they lose; the others pass as they are.
    """
    added = ("n_removed", "removed_spans")
    keep = [c for c in docs.columns if c not in added]
    docs = columns(docs, *keep)
    rule = {"min_words": min_words, "run": run, "every": every}
    by_id = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # Shards grow with the input (partitions are of bounded size), so a shard has a bounded number of spans.
    gone, _ = staged(non_first(by_id, max(64, 4 * docs.rdd.getNumPartitions()), **rule), "repeats")
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("hashes").alias("_gone_hashes"), F.col("firsts").alias("_gone_firsts"))
    marked = in_filter(docs.withColumn("_gone_key", F.col(f"`{id_col}`").cast("long")), "_gone_key", gone, "_gone_id", "_gone_hit")
    plain = marked.filter("not _gone_hit").select(*[f"`{c}`" for c in keep], F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<array<int>>").alias("removed_spans"))
    hit = marked.filter("_gone_hit").join(gone, F.col("_gone_key") == F.col("_gone_id"), "left").select(*[f"`{c}`" for c in keep], "_gone_hashes", "_gone_firsts")
    at = keep.index(text_col)
    schema = type(docs.schema)([*docs.schema.fields]).add("n_removed", "long").add("removed_spans", ArrayType(ArrayType(IntegerType())))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("spans")
        for b in batches:
            texts, removed, cut = [], [], []
            for x, h, a in zip(b.column(at), b.column(len(keep)), b.column(len(keep) + 1), strict=True):
                new, n, ranges = without(x.as_py(), h.values.to_numpy(), a.values.to_numpy(), **rule) if h.is_valid else (x.as_py(), 0, [])
                texts.append(new)
                removed.append(n)
                cut.append([[s, e] for s, e in ranges])
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(keep)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64()), pa.array(cut, pa.list_(pa.list_(pa.int32())))], [*keep, *added])

    return hit.mapInArrow(apply, schema).union(plain)


def without(text: str | None, hashes: np.ndarray, firsts: np.ndarray, **rule: int) -> tuple[str | None, int, list[tuple[int, int]]]:
    """The text without the sentences of the given spans (hash, first word), the number of those, and the removed stretches. Spans that aren't the text's own are passed over.

    A span that overlaps the first of its kind takes only the words behind that one.
    """
    if text is None:
        return None, 0, []
    h, a, b, begins = spans(text, **rule)
    at = np.searchsorted(a, firsts)
    ok = at < len(a)
    ok[ok] = (a[at[ok]] == firsts[ok]) & (h[at[ok]] == hashes[ok])
    later = np.zeros(len(h), bool)
    later[at[ok]] = True
    if not later.any():
        return text, 0, []
    kept = np.flatnonzero(~later & np.isin(h, h[later]))
    ends = dict(zip(h[kept].tolist(), b[kept].tolist(), strict=True))
    starts = np.array([max(i, ends.get(x, 0)) for x, i in zip(h[later].tolist(), a[later].tolist(), strict=True)])
    stops = b[later]
    inside = starts < stops
    edges = np.zeros(begins[-1] + 1, np.int64)
    np.add.at(edges, starts[inside], 1)
    np.add.at(edges, stops[inside], -1)
    covered = np.cumsum(edges)[:-1] > 0
    if not covered.any():
        return text, 0, []
    words = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    turns = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    ranges = [(words[i], words[j]) for i, j in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True)]
    out, last = [], 0
    for start, end in ranges:
        out.append(text[last:start])
        last = end
    return "".join([*out, text[last:]]), int(covered[begins[:-1]].sum()), ranges
