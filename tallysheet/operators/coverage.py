"""Coverage: what exists for each unit, rollups, reports, and the ledger of processed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def availability(units: DataFrame, key: str, counts: dict[str, DataFrame], years: dict[str, DataFrame]) -> DataFrame:
    """units with a count from each table of counts (key, n; missing: 0) and a sorted array of years from each of years (key, year; missing: empty)."""
    out = units
    for name, t in counts.items():
        out = out.join(t.groupBy(key).agg(F.sum("n").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    for name, t in years.items():
        out = out.join(t.groupBy(key).agg(F.array_sort(F.collect_set("year")).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>")))
    return out


def rollup(rows: DataFrame, by: Sequence[str], sums: Sequence[str], any_of: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("units"), *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sums], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in any_of.items()])


def report(metrics: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) rows from tables of one number each."""
    parts = [t.select(F.lit(k).alias("metric"), F.col(t.columns[0]).cast("long").alias("value")) for k, t in metrics.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child."""
    return parents.join(children, key, "left_anti")


def count_mismatch(parents: DataFrame, children: DataFrame, key: str, expected: str) -> DataFrame:
    """Parents whose children are other in number than expected."""
    n = children.groupBy(key).agg(F.count("*").alias("found"))
    return parents.join(n, key, "left").withColumn("found", F.coalesce("found", F.lit(0))).filter(F.col("found") != F.col(expected))


def note_fields(note: Column) -> Column:
    """key=value words of a note as a map; a word without = is passed over, the first of a repeated key counts."""
    words = F.filter(F.split(note, r"\s+"), lambda w: w.contains("="))
    pairs = F.transform(words, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(keys, p["k"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))


def latest_state(ledger: DataFrame, key: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """The last entry of each key; a stored key stays stored (sticky) whatever came later, in ever_ok."""
    return ledger.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"), F.bool_or("ok").alias("ever_ok")).select(*key, "_v.*", "ever_ok")


def pending(planned: DataFrame, ledger: DataFrame, key: Sequence[str], version: str | None = None) -> DataFrame:
    """Planned keys without a finished entry; with version, without one of that version."""
    done = ledger.filter("ok") if version is None else ledger.filter(F.col("ok") & (F.col("version") == version))
    return planned.join(done.select(*key).distinct(), list(key), "left_anti")


def unattempted(complete: DataFrame, mapped: DataFrame, attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Complete keys that are neither mapped nor in the ledger of attempts, whatever came of those."""
    return complete.join(mapped.select(*key), list(key), "left_anti").join(attempts.select(*key), list(key), "left_anti")


def plan(stages: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(stage_no, stage, items, needed, reason) from tables of what each stage still has to do."""
    parts = [t.agg(F.count("*").alias("items")).select(F.lit(i).alias("stage_no"), F.lit(name).alias("stage"), "items", (F.col("items") > 0).alias("needed"), F.when(F.col("items") > 0, F.concat(F.col("items").cast("string"), F.lit(f" {reason}"))).otherwise("complete").alias("reason")) for i, (name, t, reason) in enumerate(stages)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def provenance(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, present): non-null values of each column."""
    counts = rows.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("present")) for c in columns])).alias("x")).select("x.*")
