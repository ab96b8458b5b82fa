"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.common import released, staged

#: Edges that a task contracts at most.
EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").hint("merge").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.hint("merge").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v")))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: each of its nodes is tied to the least that it is connected with there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if (a := root(u)) != (c := root(v)):
                parent[max(a, c)] = min(a, c)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = nodes[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, edges_a_task: int = EDGES) -> DataFrame:
    """(node, component): each node of an edge table (u, v) of longs and the least node it is connected with.

    The edges are dealt to as many tasks as hold edges_a_task each, and each task contracts its own. What one task has seen
    whole is done; the stars of several go through large-star and small-star steps by turns (Kiveris et al. 2014) until
    the table no longer changes. Each step is staged in the shared folder, so a lost executor costs a re-read. Self-loops are
    passed over; nodes without another edge aren't in the result.
    """
    spark = edges.sparkSession
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    found, path = staged(pairs, "edges")
    tasks = max(1, -(-found.count() // edges_a_task))
    now, new_path = staged(found.repartition(tasks).mapInArrow(_contracted, "u long, v long").filter("u <> v"), "edges")
    released(spark, path)
    path, before = new_path, None
    while tasks > 1:
        then, new_path = staged(_small_star(_large_star(now)).filter("u <> v").distinct(), "edges")
        released(spark, path)
        now, path = then, new_path
        state = _state(now)
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
