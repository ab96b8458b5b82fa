"""N-gram Jaccard join: an exact join of documents by their shingle sets, with vertically partitioned overlap counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallysheet.llm.common import columns, in_filter, in_slices, kept_by_worker, released, staged, words_of
from tallysheet.llm.components import components

#: Counters of the global order, and of them in a chunk.
COUNTERS, CHUNK = 1 << 21, 1 << 15
#: An n-gram whose counter is less stands in fewer documents than this, and its list is one group of a window.
HOT = 50_000
#: Words of 64 bits in the sketch of a set that bounds overlaps.
SKETCH = 16
#: Sets of a list that its others are compared with in the first round that takes more than one, and pairs of two components that are then counted. Both grow by GROWTH from round to round.
AT_FIRST, PAIRS_AT_FIRST, GROWTH = 100, 4, 8


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word n-grams, sorted; with fewer words, of the whole sequence; none without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    s = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        s = _mix(s) + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(s + np.uint64(size)))


def fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a sorted set: equal sets are told by it alone."""
    return xxhash.xxh3_128_digest(s.tobytes())


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join at every size, so that a plan that holds for a sample holds for the whole; adaptive execution splits hot keys."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def required(na: Column | str, nb: Column | str, num: int, den: int) -> Column:
    """The least overlap of two sets of these sizes whose Jaccard similarity is num / den or more: ceil(num (na + nb) / (num + den))."""
    total = (F.col(na) if isinstance(na, str) else na) + (F.col(nb) if isinstance(nb, str) else nb)
    return F.floor((total * num + (num + den - 1)) / F.lit(num + den)).cast("long")


class Order:
    """The global order of n-grams: rarer counters first, then by hash. cuts: the counts at which its fragments begin."""

    def __init__(self, counts: np.ndarray, fragments: int) -> None:
        self.counts = counts
        levels = np.sort(counts)
        mass = np.cumsum(levels, dtype=np.float64)
        at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments) if mass[-1] else []
        self.cuts = np.unique(levels[at]) if len(at) else np.empty(0, counts.dtype)

    def rank(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in the global order, and the counts."""
        c = self.counts[s & np.uint64(len(self.counts) - 1)]
        o = np.lexsort((s, c))
        return s[o], c[o]

    def fragments(self, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(fragment, its part of the set, sorted by hash) for each that isn't empty."""
        f = np.searchsorted(self.cuts, self.counts[s & np.uint64(len(self.counts) - 1)], side="right")
        for i in np.unique(f):
            yield int(i), s[f == i]


def global_order(docs: DataFrame, size: int, fragments: int, counters: int = COUNTERS) -> Order:
    """Document frequencies of all n-grams of all documents, in a fixed number of counters that n-grams share by hash.

    Any total order gives the same links; this one puts frequent n-grams last. Tasks count for themselves and
    their counters are added up chunk by chunk, as a stream; the driver gets the counters only.
    """
    chunk = min(CHUNK, counters)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        kept_by_worker("jaccard")
        total = np.zeros(counters, np.uint32)
        for b in batches:
            for text in b.column(1):
                if len(s := shingles(text.as_py(), size)):
                    np.add.at(total, (s & np.uint64(counters - 1)).astype(np.int64), 1)
        z = zstandard.ZstdCompressor(level=1)
        rows = [(i // chunk, z.compress(total[i : i + chunk].tobytes())) for i in range(0, counters, chunk) if total[i : i + chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z, at, total = zstandard.ZstdDecompressor(), None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != at:
                    if at is not None:
                        yield give()
                    at, total = k, np.zeros(chunk, np.uint32)
                total += np.frombuffer(z.decompress(part.as_py()), np.uint32)
        if at is not None:
            yield give()

    parts = docs.mapInArrow(count, "chunk int, counts binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(counters, np.uint32)
    for r in parts.toLocalIterator():
        out[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r["counts"], np.uint32)
    return Order(out, fragments)


def sketch(s: np.ndarray) -> np.ndarray:
    """A bit for each n-gram, by hash. Each bit that another set's sketch lacks is an n-gram that the other lacks."""
    out, bit = np.zeros(SKETCH, np.uint64), (s >> np.uint64(40)) % np.uint64(64 * SKETCH)
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.view(np.int64)


def lacking(a: str, b: str) -> Column:
    """Bits of sketch a that b lacks: at least so many n-grams of a's set aren't in b's."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)


def signatures(docs: DataFrame, size: int, num: int, den: int, order, hot: int) -> DataFrame:
    """(doc_id, n, node, bits, prefix, cold): the set's size, its fingerprint (node) and sketch, as many of its first n-grams in the global order as a linked set must share one of, and how many of those aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        for b in batches:
            n, node, bits, prefix, cold = [], [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                node.append(fingerprint(s) if len(s) else None)
                bits.append(sketch(s))
                first, counts = (x[: len(s) - -(-num * len(s) // den) + 1 if len(s) else 0] for x in ranked.rank(s))
                prefix.append(first.view(np.int64))
                cold.append(int(np.searchsorted(counts, hot)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(cold, pa.int32())], ["doc_id", "n", "node", "bits", "prefix", "cold"])

    return docs.mapInArrow(run, "doc_id long, n long, node binary, bits array<long>, prefix array<long>, cold int")


def representatives(sets: DataFrame) -> DataFrame:
    """(node, id, rep): the least document of each set. Copies are combined before the shuffle.

    id is a number for the set: that of its least document. Where rows repeat an id with other texts, it may be the least of
    two sets; then one of them has a hash of the set as its number.
    """
    light = sets.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    first = F.row_number().over(Window.partitionBy("rep").orderBy("node")) == 1
    return light.withColumn("id", F.when(first, F.col("rep")).otherwise(F.xxhash64("node")))


def postings(sets: DataFrame, reps: DataFrame) -> DataFrame:
    """(token, id, n, pos, head) for the prefixes of each set, of tokens that stand in two sets or more; head is one set of the token's list, by hash of token and set: a group that shares many tokens gets as many heads.

    Tokens that aren't hot have bounded lists, which are windows. Lists of hot ones are aggregated, and joined to their heads: adaptive execution can split them.
    """
    own = merged(sets.select(F.col("doc_id").alias("rep"), "node", "n", "prefix", "cold"), reps, ["rep", "node"])
    one = own.select("id", "n", "cold", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    parts = [one.filter(f"pos {op} cold").select("token", "id", "n", "pos") for op in ("<", ">=")]
    near = Window.partitionBy("token").orderBy(F.xxhash64("token", "id"), "id")
    cold = parts[0].withColumn("_before", F.lag("id").over(near)).withColumn("_after", F.lead("id").over(near))
    cold = cold.withColumn("head", F.first(F.struct("id", "n", "pos")).over(near.rowsBetween(Window.unboundedPreceding, 0))).filter("(_before is not null or _after is not null) and not (_before <=> id)")
    head = F.min(F.struct(F.xxhash64("token", "id").alias("h"), "id", "n", "pos"))
    heads = parts[1].groupBy("token").agg(head.alias("h"), F.count("*").alias("_k")).filter("_k > 1").select("token", F.struct("h.id", "h.n", "h.pos").alias("head"))
    names = ["token", "id", "n", "pos", "head"]
    return cold.select(names).union(merged(parts[1], heads, "token").select(names))


def to_bytes(s: np.ndarray) -> bytes:
    """Sorted hashes by their differences, byte by byte of the same rank, compressed: the upper bytes are mostly 0."""
    import zstandard

    x = np.diff(s, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.T).tobytes())


def from_bytes(b: bytes) -> np.ndarray:
    import zstandard

    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(x.T).view("<u8").ravel(), dtype=np.uint64)


def linked(pairs: DataFrame, docs: DataFrame, reps: DataFrame, order, size: int, num: int, den: int) -> DataFrame:
    """pairs (a, b, na, nb) with inter, their overlap: counted in each fragment of the order on its own and summed by pair.

    Only documents in the pairs are cut into fragments: a filter of a fixed number of bits passes them (and a few more, which join nothing).
    """
    ends = merged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), reps.select("id", "node", "rep"), "id")
    wanted = in_filter(docs.filter("doc_id is not null"), "doc_id", ends.select("rep"), "rep", "_in").filter("_in").select("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = order.value
        for b in batches:
            rows = []
            for text in b.column(0):
                if len(s := shingles(text.as_py(), size)):
                    node = fingerprint(s)
                    rows += [(node, f, to_bytes(part)) for f, part in ranked.fragments(s)]
            for i, j in in_slices(rows, [len(r[2]) for r in rows], 16_000_000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i:j]], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], ["node", "fragment", "part"])

    parts = wanted.mapInArrow(cut, "node binary, fragment int, part binary")
    fragments = len(order.value.cuts) + 1
    named = lambda end: ends.select(F.col("id").alias(end), F.col("node").alias(f"node_{end}"))
    sets_of = merged(merged(pairs.select("a", "b"), named("a"), "a"), named("b"), "b")
    by_fragment = sets_of.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    left = parts.select(F.col("node").alias("node_a"), "fragment", F.col("part").alias("pa"))
    right = parts.select(F.col("node").alias("node_b"), "fragment", F.col("part").alias("pb"))
    # Sort-merge joins at every size: sets are shuffled once, by node and fragment, and pairs carry one side's part to the other.
    both = merged(merged(by_fragment, left, ["node_a", "fragment"]), right, ["node_b", "fragment"]).select("a", "b", "fragment", "pa", "pb")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(np.intersect1d(from_bytes(x.as_py()), from_bytes(y.as_py()), assume_unique=True)) for x, y in zip(b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64())], ["a", "b", "fragment", "partial"])

    # Copies that passed the filter have the same parts: one count of each fragment is taken.
    counts = both.mapInArrow(overlap, "a long, b long, fragment int, partial long").groupBy("a", "b", "fragment").agg(F.max("partial").alias("partial"))
    sums = counts.groupBy("a", "b").agg(F.sum("partial").alias("inter"))
    return merged(pairs, sums, ["a", "b"]).filter(F.col("inter") >= required("na", "nb", num, den))


def jaccard_join(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", fragments: int = 4, min_rounds: int = 1, rest_factor: int = 100, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles (size of its set of word n-grams) and component_id.

    Words are runs of other than space and U+0009 to U+000D, A-Z in lower case. Two documents link when their sets'
    overlap is num / den of their union or more; component_id is the least doc_id reachable by links. A text
    of fewer words than size is one n-gram; one without words has an empty set, links with nothing and is its own component.

    1. Equal sets fall together by fingerprint; one document stands for each set.
    2. All n-grams are counted for a global order, rare ones first. Linked sets share one of the first n-grams of both
       (prefix filter), at places that leave room for the overlap they need.
    3. Sets that share such an n-gram are candidates. A list of many sets isn't multiplied out: in rounds, each set is
       compared with one of its list's (of its largest component), and components grow, until the pairs that remain
       between different components are few against the lists, or, after min_rounds, a round links half of its pairs or fewer.
       Then each set meets a sample of its list, but for pairs whose sketches show that too many n-grams differ. Of those of two components only the
       few whose sketches are most alike are counted: one link joins both, and the rest isn't needed. Sample and number grow from round to round
       until the sample is the whole list and no pair of two components is held back. So no link between components is lost, and none within one is needed.
       A list is long only if many sets have hardly an n-gram that is rarer; such sets are mostly alike, and rounds join them.
    4. The overlap of a pair is counted in each fragment of the global order separately, and summed.

    N-grams are 64-bit hashes, sets are told apart by 128 bits. Runs jobs while the DataFrame is being built. Null ids get a null component. Rows that repeat an id are compared each on its own.
    An empty table gives none. Other columns are left out.
    """
    spark = docs.sparkSession
    docs = columns(docs, *dict.fromkeys([id_col, text_col])).selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    order = spark.sparkContext.broadcast(global_order(docs, size, fragments))
    whole, whole_path = staged(signatures(docs, size, num, den, order, hot), "signatures")
    reps, _ = staged(representatives(whole), "reps")
    shared, shared_path = staged(postings(whole, reps), "postings")
    sets, _ = staged(whole.select("doc_id", "n", "node", "bits"), "sets")
    released(spark, whole_path)
    checked, labels, edges, shapes, done_with = None, None, None, None, []
    last, whole_lists, held, waiting, sample, most = False, False, False, None, AT_FIRST, PAIRS_AT_FIRST
    need = required("na", "nb", num, den)
    for i in itertools.count():
        if i == 0:
            found = shared.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("head.id").alias("b"), F.col("head.n").alias("nb"), F.col("head.pos").alias("pb")).filter("a <> b")
        else:
            rows = merged(shared.drop("head"), labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
            pick = F.min(F.struct(F.xxhash64(F.lit(i), "token", "id").alias("h"), "id", "n", "pos"))
            lists = rows.groupBy("token", "component").agg(F.count("*").alias("k"), pick.alias("p"))
            lists = lists.groupBy("token").agg(F.max(F.struct("k", F.col("component").alias("c"), "p")).alias("m"), F.sum("k").alias("total"), F.count("*").alias("components"))
            lists = lists.filter("components > 1").select("token", F.col("m.c").alias("main"), F.col("m.p.id").alias("b"), F.col("m.p.n").alias("nb"), F.col("m.p.pos").alias("pb"), F.col("m.k").alias("k"), "total")
            lists, lists_path = staged(lists, "lists")
            remaining = lists.agg(F.count("*").alias("tokens"), F.sum("total").alias("rows"), F.max("total").alias("longest"), F.sum((F.col("total") - F.col("k")).cast("double") * F.col("total")).alias("pairs")).first()
            if not remaining["tokens"] and not held:
                done_with.append(lists_path)
                break
            if last:
                sample, most = sample * GROWTH, most * GROWTH
            last = last or remaining["pairs"] <= rest_factor * remaining["rows"] or (i >= min_rounds and 2 * n_links <= n_pairs)
            whole_lists = last and (remaining["longest"] or 0) <= sample
            # Lists of one component stay so, and those whose sample was whole have all of their candidates in waiting: later rounds read the others only.
            near, near_path = staged(merged(rows, lists, "token"), "near")
            released(spark, lists_path, shared_path)
            shared, shared_path = (near.filter(F.col("total") > sample) if last else near).select("token", "id", "n", "pos"), near_path
            if last:
                if shapes is None:
                    met = merged(near.select("id").distinct(), reps.select("id", "node"), "id")
                    shapes, shapes_path = staged(merged(sets.select("node", "bits").dropDuplicates(["node"]), met, "node").select("id", "bits"), "shapes")
                    done_with.append(shapes_path)
                near = merged(near.select("token", "id", "n", "pos", "component", "main", "total"), shapes, "id")
                left = near.filter("component <> main").select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), F.col("bits").alias("ba"), "main")
                right = near.filter(F.pmod(F.xxhash64(F.lit(i), "token", "id"), F.col("total")) < sample).select("token", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), F.col("bits").alias("bb"))
                # A pair of sets that are both outside the largest component would come twice.
                apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
                room = (F.col("na") - F.col("pa") >= need) & (F.col("nb") - F.col("pb") >= need)
                spare = F.least(F.col("na") - lacking("ba", "bb"), F.col("nb") - lacking("bb", "ba")) - need
                found = merged(left, right, (left["token"] == right["token"]) & apart & room & (spare >= 0)).drop(left["token"]).withColumn("spare", spare)
            else:
                found = near.filter("component <> main").select("token", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "b", "nb", "pb")
        found = found.filter((F.col("na") - F.col("pa") >= need) & (F.col("nb") - F.col("pb") >= need))
        swap = F.col("a") > F.col("b")
        ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb")]
        found = found.select(*ends, *([F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "spare"] if last else []))
        if waiting is not None:
            for end in ("a", "b"):
                own = labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}_now"))
                waiting = merged(waiting, own, end, "left").withColumn(f"c{end}_now", F.coalesce(f"c{end}_now", end))
            found = found.union(waiting.filter("ca_now <> cb_now").select("a", "b", "na", "nb", F.least("ca_now", "cb_now"), F.greatest("ca_now", "cb_now"), "spare"))
        found = found.distinct()
        if checked is not None:
            found = merged(found, checked, ["a", "b"], "left_anti")
        if last:
            waiting, waiting_path = staged(found, "candidates")
            done_with.append(waiting_path)
            # The pair with most to spare of each bucket; the others wait until its links are known.
            best = waiting.groupBy("ca", "cb", F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("bucket")).agg(F.max(F.struct("spare", "a", "b", "na", "nb")).alias("p"), ((F.min("a") < F.max("a")) | (F.min("b") < F.max("b"))).alias("more"))
            found = best.select("p.a", "p.b", "p.na", "p.nb", "more")
        pairs, pairs_path = staged(found, "pairs")
        done_with.append(pairs_path)
        n_pairs, held = pairs.count(), last and not pairs.filter("more").isEmpty()
        pairs = pairs.select("a", "b", "na", "nb")
        checked = pairs.select("a", "b") if checked is None else checked.union(pairs.select("a", "b"))
        n_links = 0
        if n_pairs or edges is None:
            good, good_path = staged(linked(pairs, docs, reps, order, size, num, den).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
            done_with.append(good_path)
            n_links = good.count()
            edges = good if edges is None else edges.union(good)
            labels, _ = staged(components(edges).withColumnRenamed("node", "id"), "labels")
        if whole_lists and not held:
            break
    done_with.append(shared_path)
    released(spark, *done_with)
    named = merged(reps.select("id", "node", "rep").distinct(), labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = merged(named, least, "component").select("node", "component_id")
    out = merged(sets.select("doc_id", "n", "node"), ids, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
