"""Ordered rows: clusters by gaps, values carried forward, nearest anchors, running sums, robust cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_clusters(rows: DataFrame, group: Sequence[str], value: Column, tolerance: Column | float, tie: Sequence[str] = ()) -> DataFrame:
    """rows with cluster: a new one begins where value is more than tolerance above the one before."""
    w = Window.partitionBy(*group).orderBy("_v", *tie)
    r = rows.withColumn("_v", value)
    r = r.withColumn("_new", F.when(F.col("_v") - F.lag("_v").over(w) > tolerance, 1).otherwise(0))
    return r.withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_v", "_new")


def carry_forward(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """rows with the last non-null value at or before each."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, right_at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of right's last row of the same key at or before `at` (suffix _asof): both are sorted together once, no pair is made."""
    l = left.withColumn("_t", F.col(at)).withColumn("_right", F.lit(False))
    r = right.select(*by, F.col(right_at).alias("_t"), F.struct(*values).alias("_v")).withColumn("_right", F.lit(True))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter(~F.col("_right"))
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(f"{v}_asof") for v in values])


def nearest(rows: DataFrame, anchors: DataFrame, by: Sequence[str], at: str, anchor_at: str, anchor: str, tolerance: int) -> DataFrame:
    """rows with the nearest anchor of the same key within tolerance (ties: the smaller anchor), else null.

    Both sides are put in buckets of the tolerance's width; a row meets its own bucket and the two beside it. Repeated
    rows stay repeated: each has a number of its own before it is dealt to buckets.
    """
    width = max(1, tolerance)
    r = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_id", F.monotonically_increasing_id()).withColumn("_b", F.floor(F.col(at) / width)).withColumn("_bucket", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)))
    a = anchors.select(*[F.col(k).alias(f"_a_{k}") for k in by], F.col(anchor_at).alias("_aat"), F.col(anchor).alias("_anchor")).withColumn("_abucket", F.floor(F.col("_aat") / width))
    cond = (F.col("_bucket") == F.col("_abucket")) & (F.abs(F.col(at) - F.col("_aat")) <= tolerance)
    for k in by:
        cond = cond & (F.col(k) == F.col(f"_a_{k}"))
    best = r.join(a, cond, "left").groupBy("_id").agg(F.any_value("_row").alias("_row"), F.min(F.when(F.col("_anchor").isNotNull(), F.struct(F.abs(F.col(at) - F.col("_aat")).alias("d"), F.col("_anchor").alias("x")))).alias("_best"))
    return best.select("_row.*", F.col("_best.x").alias("nearest"), F.col("_best.d").alias("distance"))


def running_identity(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """rows with before_sum (of the values before) and is_total: the value equals that sum."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before_sum", F.sum(value).over(w)).withColumn("is_total", F.coalesce(F.col(value) == F.col("before_sum"), F.lit(False)))


def median_cut(rows: DataFrame, group: Sequence[str], value: str, times: float = 3, beyond: float = 400) -> DataFrame:
    """rows without those over the greater of times * median and median + beyond of their group."""
    m = rows.groupBy(*group).agg(F.median(value).alias("_median"))
    return rows.join(m, list(group)).filter(F.col(value) <= F.greatest(times * F.col("_median"), F.col("_median") + beyond)).drop("_median")


def richest(rows: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def dense_values(rows: DataFrame, group: Sequence[str], row: str, value: str, share: float = 0.3) -> DataFrame:
    """Values that stand in at least that share of a group's rows."""
    n = rows.groupBy(*group).agg(F.countDistinct(row).alias("_rows"))
    v = rows.groupBy(*group, value).agg(F.countDistinct(row).alias("rows_with"))
    return v.join(n, list(group)).filter(F.col("rows_with") >= share * F.col("_rows")).drop("_rows")


def trusted(rows: DataFrame, group: Sequence[str], holds: Column, value: str, share: float = 0.8) -> DataFrame:
    """rows whose value is null in groups where the identity holds in less than that share of the rows."""
    w = Window.partitionBy(*group)
    return rows.withColumn(value, F.when(F.avg(holds.cast("int")).over(w) >= share, F.col(value)))
