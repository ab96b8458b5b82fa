"""Result rows: checks against printed totals, margins, summaries, tallies and comparisons between elections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions import arrays
from tallysheet.functions.numbers import MARGIN_BINS


def modal_size(rows: DataFrame, sheet: Sequence[str], votes: str = "votes") -> DataFrame:
    """For each sheet, the number of columns that more than half of its rows with votes have; null without such a majority."""
    sizes = rows.filter(F.col(votes).isNotNull()).groupBy(*sheet, F.size(votes).alias("_size")).agg(F.count("*").alias("_n"))
    total = sizes.groupBy(*sheet).agg(F.sum("_n").alias("_total"), F.max(F.struct("_n", "_size")).alias("_top"))
    return total.select(*sheet, F.when(F.col("_top._n") * 2 > F.col("_total"), F.col("_top._size")).alias("expected_columns"))


def checked(rows: DataFrame, sheet: Sequence[str], votes: str = "votes", valid: str = "total_valid") -> DataFrame:
    """rows with expected_columns and status; sheets are few against rows, so Spark may broadcast them when it sees their size."""
    out = rows.join(modal_size(rows, sheet, votes), list(sheet), "left")
    return out.withColumn("status", arrays.row_status(F.col(votes), F.col(valid), F.col("expected_columns")))


def with_margin(rows: DataFrame, votes: str = "votes", valid: str = "total_valid") -> DataFrame:
    """checked rows with the struct margin, only where the status is ok."""
    return rows.withColumn("margin", F.when(F.col("status") == "ok", arrays.margin(F.col(votes), F.col(valid))))


def medians(rows: DataFrame, by: Sequence[str], **values: Column) -> DataFrame:
    """The exact median of each named value in each group.

    A group may hold all rows, so its values aren't sorted in one task: quantiles found approximately bound the median, and only the
    values between them (about a thousandth) are counted and ordered; those below are just counted.
    """
    out = None
    for name, value in values.items():
        r = rows.filter(value.isNotNull()).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(by)], value.cast("double").alias("_v"))
        keys = [f"_g{i}" for i in range(len(by))]
        q = F.percentile_approx("_v", F.array(F.lit(0.4995), F.lit(0.5005)), F.lit(20_000))
        ends = r.groupBy(*keys).agg(F.count("*").alias("_n"), q.alias("_q")).select(*[F.col(k).alias(f"_e{k}") for k in keys], "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
        near = r.join(ends, [F.col(k).eqNullSafe(F.col(f"_e{k}")) for k in keys]).withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))).filter("_v is null or _v <= _hi")
        # Values below the bracket are one row (null), which comes first.
        w = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v"))
        c = near.groupBy(*keys, "_v").agg(F.count("*").alias("_c"), F.any_value("_n").alias("_n")).withColumn("_to", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        at = lambda k: F.max(F.when((F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k), F.col("_v")))  # noqa: E731, B023
        m = c.groupBy(*keys).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))
        m = m.select(*[F.col(k).alias(f"_m{len(out.columns) if out is not None else 0}{k}") for k in keys], name)
        if out is None:
            out, first = m, m.columns[:-1]
        else:
            out = out.join(m, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(first, m.columns, strict=False)], "full").drop(*m.columns[:-1])
    return out.select(*[F.col(a).alias(g) for a, g in zip(first, by, strict=True)], *values)


def summary(rows: DataFrame, by: Sequence[str], id_col: str, valid: str = "total_valid") -> DataFrame:
    """For each group: rows, votes (null: 0), verified, review, medians of margin and margin_pct, close rows (under 5 %), narrowest and widest row (least id at ties)."""
    m, pct = F.col("margin.margin"), F.col("margin.margin_pct")
    has = F.when(m.isNotNull(), F.struct(m.alias("m"), F.col(id_col).alias("id")))
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.coalesce(valid, F.lit(0))).alias("valid_votes"),
        F.count_if(F.col("status") == "ok").alias("verified"),
        F.count_if(F.col("status") != "ok").alias("review"),
        F.count_if(pct < 5).alias("close"),
        F.min(has)["id"].alias("narrowest"),
        F.max(F.when(m.isNotNull(), F.struct(m.alias("m"), (-F.col(id_col)).alias("id"))))["id"].alias("_widest"),
    ).withColumn("widest", -F.col("_widest")).drop("_widest")
    mid = medians(rows, by, median_margin=m, median_margin_pct=pct)
    mid = mid.select(*[F.col(g).alias(f"_m_{g}") for g in by], "median_margin", "median_margin_pct")
    return counts.join(mid, [F.col(g).eqNullSafe(F.col(f"_m_{g}")) for g in by], "left").drop(*[f"_m_{g}" for g in by])


def histogram(rows: DataFrame, by: Sequence[str], pct: Column) -> DataFrame:
    """Counts of margins in each bin, empty bins included, for each group that has rows."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(MARGIN_BINS)])).alias("b")
    groups = rows.select(*by).distinct().select(*by, bins).select(*by, "b.bin")
    at = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(MARGIN_BINS):
        at = F.when((pct >= lo) & (pct < hi), i).otherwise(at)
    counts = rows.withColumn("bin", at).filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return groups.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def group_check(rows: DataFrame, by: Sequence[str], parts: Sequence[str], total: str, printed: str, order: str) -> DataFrame:
    """For each group: the first rule that fails. A row whose parts (all non-null) don't add up to its total; then the first printed total that isn't the totals' sum."""
    known = F.lit(True)
    for p in parts:
        known = known & F.col(p).isNotNull()
    wrong = known & (sum((F.col(p) for p in parts[1:]), F.col(parts[0])) != F.coalesce(F.col(total), F.lit(-1)))
    out = rows.groupBy(*by).agg(F.coalesce(F.bool_or(wrong), F.lit(False)).alias("_wrong"), F.sum(total).alias("sum_total"), F.min_by(printed, F.when(F.col(printed).isNotNull(), F.col(order))).alias("printed_total"))
    status = F.when(F.col("_wrong"), "row_mismatch").when(F.col("printed_total").isNotNull() & (F.col("printed_total") != F.coalesce("sum_total", F.lit(0))), "total_mismatch").otherwise("ok")
    return out.withColumn("status", status).drop("_wrong")


def winners(rows: DataFrame, by: Sequence[str], votes: str, id_col: str, name: str) -> DataFrame:
    """For each group: winner, runner-up, margin, margin_pct and votes; ties go to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc(votes), F.asc(id_col))
    first = rows.withColumn("_rank", F.row_number().over(w)).groupBy(*by).agg(
        F.max(F.when(F.col("_rank") == 1, F.struct(F.col(name).alias("name"), F.col(votes).alias("v")))).alias("a"),
        F.max(F.when(F.col("_rank") == 2, F.struct(F.col(name).alias("name"), F.col(votes).alias("v")))).alias("b"),
        F.sum(votes).alias("total_votes"),
    )
    margin = F.col("a.v") - F.col("b.v")
    return first.select(*by, F.col("a.name").alias("winner"), F.col("b.name").alias("runner_up"), F.col("a.v").alias("winner_votes"), margin.alias("margin"), F.when(F.col("total_votes") != 0, margin * 100 / F.col("total_votes")).alias("margin_pct"), "total_votes")


def tally(wins: DataFrame, by: Sequence[str], winner: str = "winner") -> DataFrame:
    """Groups won by each name; a null name is a dash."""
    return wins.groupBy(*by, F.coalesce(F.col(winner).cast("string"), F.lit("—")).alias("party")).agg(F.count("*").alias("seats"))


def winner_changes(wins: DataFrame, group: Sequence[str], year: str, winner: str = "winner") -> DataFrame:
    """wins with the winner of the group's election before, and whether it changed (null for the first)."""
    w = Window.partitionBy(*group).orderBy(year)
    before = F.lag(winner).over(w)
    return wins.withColumn("previous", before).withColumn("changed", F.when(F.col("previous").isNotNull(), F.col("previous") != F.col(winner)))


def matrix(rows: DataFrame, by: Sequence[str], year: str, years: Sequence[int], value: Column, prefix: str = "y") -> DataFrame:
    """A row for each group and a column for each year. The years are given, so no pass is needed to find them."""
    return rows.groupBy(*by).pivot(year, list(years)).agg(value).select(*by, *[F.col(f"`{y}`").alias(f"{prefix}{y}") for y in years])


def latest(rows: DataFrame, by: Sequence[str], order: Column, *values: str) -> DataFrame:
    """For each group, the values of its last row in order."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), order).alias("_r")).select(*by, "_r.*")


def shares(rows: DataFrame, group: Sequence[str], name: str, votes: str, least: float = 0.01, always: Sequence[str] = ("NOTA",)) -> DataFrame:
    """Votes and share of each name of a group; those of a share under `least` are `Others` together, but for names that are always shown."""
    w = Window.partitionBy(*group)
    r = rows.groupBy(*group, name).agg(F.sum(votes).alias("votes")).withColumn("_all", F.sum("votes").over(w))
    shown = (F.col("votes") >= least * F.col("_all")) | F.col(name).isin(*always)
    out = r.groupBy(*group, F.when(F.coalesce(shown, F.lit(False)), F.col(name)).otherwise(F.lit("Others")).alias("name")).agg(F.sum("votes").alias("votes"), F.any_value("_all").alias("_all"))
    return out.withColumn("share", F.when(F.col("_all") != 0, F.col("votes") / F.col("_all"))).drop("_all")
