"""Record quality: validation, duplicates, gaps and outliers in numbering, aggregates, flags, health and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions import text
from tallysheet.functions.numbers import percent

RELATIONS = ("FATHER", "MOTHER", "HUSBAND", "OTHER")
LOW_ROW, LOW_MEAN, LOW_SHARE = 0.95, 0.98, 0.05
LEVELS = ("bad", "warn", "info", "good")


def notes(*rules: Column) -> Column:
    """The messages of the rules that fire (a rule is null otherwise), joined; empty if none does."""
    return F.array_join(F.filter(F.array(*rules), lambda x: x.isNotNull()), "; ")


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with dup_rank: 1 for the first row of each key in order."""
    return rows.withColumn("dup_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def validated(people: DataFrame, roll: str = "roll_id", pos: str = "pos", expected_part: str | None = None) -> DataFrame:
    """People of a roll with validation_notes, is_valid, duplicate_kind and duplicate_of (a serial).

    Rules in order: serial missing, name missing, age out of range, gender unknown, relation unknown, id format, part
    mismatch, exact duplicate (a serial that stood before), fuzzy duplicate (name, relative and age that stood before, none empty; it
    names the kind when both fire). The first row of a group is never flagged.
    """
    name, rel = text.name_key(F.col("name")), text.name_key(F.col("relative_name"))
    p = people.withColumn("_name", name).withColumn("_rel", rel)
    whole = (F.col("_name") != "") & (F.col("_rel") != "") & F.col("age").isNotNull()
    exact = Window.partitionBy(roll, "serial").orderBy(pos)
    fuzzy = Window.partitionBy(roll, "_name", "_rel", "age").orderBy(pos)
    p = p.withColumn("_exact", F.when(F.col("serial").isNotNull() & (F.row_number().over(exact) > 1), F.col("serial")))
    p = p.withColumn("_fuzzy", F.when(whole & (F.row_number().over(fuzzy) > 1), F.first("serial").over(fuzzy)))
    is_fuzzy = whole & (F.row_number().over(fuzzy) > 1)
    part = F.when(F.col("part_number") != F.col(expected_part), "part number mismatch") if expected_part else F.lit(None).cast("string")
    rules = [
        F.when(F.col("serial").isNull(), "serial missing"),
        F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "name missing"),
        F.when(~F.col("age").between(*text.AGES), "age out of range"),
        F.when(text.gender(F.col("gender")) == "UNKNOWN", "gender unknown"),
        F.when(~F.coalesce("relative_type", F.lit("")).isin(*RELATIONS), "relation unknown"),
        F.when((F.coalesce("id_number", F.lit("")) != "") & ~text.id_format(F.col("id_number")), "id format"),
        part,
        F.when(F.col("_exact").isNotNull(), F.concat(F.lit("duplicate serial "), F.col("_exact"))),
        F.when(is_fuzzy, F.concat(F.lit("same person as serial "), F.coalesce(F.col("_fuzzy").cast("string"), F.lit("?")))),
    ]
    kind = F.when(is_fuzzy, "fuzzy").when(F.col("_exact").isNotNull(), "exact")
    of = F.when(is_fuzzy, F.col("_fuzzy")).otherwise(F.col("_exact"))
    out = p.withColumns({"validation_notes": notes(*rules), "duplicate_kind": kind, "duplicate_of": of})
    return out.withColumn("is_valid", F.col("validation_notes") == "").drop("_name", "_rel", "_exact", "_fuzzy")


def linked_duplicates(rows: DataFrame, group: str, serial: str, duplicate_of: str, id_col: str = "id") -> DataFrame:
    """(id, original_id): for each duplicate, the least other id of its group with the serial that it repeats."""
    o = rows.select(F.col(group).alias("_g"), F.col(serial).alias("_s"), F.col(id_col).alias("_id"))
    d = rows.filter(F.col(duplicate_of).isNotNull())
    return d.join(o, (d[group] == o["_g"]) & (d[duplicate_of] == o["_s"]) & (d[id_col] != o["_id"])).groupBy(id_col).agg(F.min("_id").alias("original_id"))


def gaps(rows: DataFrame, group: Sequence[str], number: str, upper: Column | None = None, from_one: bool = True) -> DataFrame:
    """For each group, the numbers that are missing from 1 (or the least) to upper (or the greatest): missing, an array of ranges (first, last) in order, and n_missing.

    Ranges, so that a stray number of two thousand million costs no more than any other. upper is an aggregate; numbers above it don't count.
    """
    w = Window.partitionBy(*group).orderBy(number)
    least = F.lit(1) if from_one else F.min(number)
    ends = rows.groupBy(*group).agg(least.cast("long").alias("_lo"), (upper if upper is not None else F.max(number)).cast("long").alias("_hi"))
    have = rows.filter(F.col(number).isNotNull()).select(*group, F.col(number).cast("long").alias(number)).distinct()
    for g in group:
        have, ends = have.withColumn(f"_key_{g}", F.col(g)), ends.withColumn(f"_end_{g}", F.col(g))
    same = [F.col(f"_key_{g}").eqNullSafe(F.col(f"_end_{g}")) for g in group]
    inside = have.drop(*group).join(ends.drop(*group), same).filter(F.col(number).between(F.col("_lo"), F.col("_hi"))).select(*[F.col(f"_key_{g}").alias(g) for g in group], number, "_lo", "_hi")
    inside = inside.withColumn("_after", F.lead(number).over(w)).withColumn("_before", F.lag(number).over(w))
    behind = F.struct((F.col(number) + 1).alias("first"), (F.coalesce("_after", F.col("_hi") + 1) - 1).alias("last"))
    ahead = F.struct(F.col("_lo").alias("first"), (F.col(number) - 1).alias("last"))
    holes = F.filter(F.when(F.col("_before").isNull(), F.array(ahead, behind)).otherwise(F.array(behind)), lambda x: x["first"] <= x["last"])
    found = inside.groupBy(*group).agg(F.array_sort(F.flatten(F.collect_list(holes))).alias("missing"))
    for g in group:
        found = found.withColumn(f"_key_{g}", F.col(g))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    whole = F.when(F.col("_hi") >= F.col("_lo"), F.array(F.struct(F.col("_lo").alias("first"), F.col("_hi").alias("last")))).otherwise(none)
    out = ends.drop(*group).join(found.drop(*group), same, "left").select(*[F.col(f"_end_{g}").alias(g) for g in group], F.coalesce("missing", whole).alias("missing"))
    return out.withColumn("n_missing", F.aggregate("missing", F.lit(0).cast("bigint"), lambda a, r: a + r["last"] - r["first"] + 1))


def tail_outliers(rows: DataFrame, group: Sequence[str], number: str, jump: int = 100, fewest: int = 10) -> DataFrame:
    """For each group, the numbers far beyond the main run.

    From the top, as long as the difference to the next smaller number is over jump: the tail from there up is stray if it has at
    most max(3, n // 100) numbers. The largest such tail counts. Groups of under `fewest` numbers have none. Repeated numbers count.
    """
    up = Window.partitionBy(*group).orderBy(number)
    down = Window.partitionBy(*group).orderBy(F.desc(number), F.desc("_at")).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.filter(F.col(number).isNotNull()).select(*group, number).withColumn("_at", F.row_number().over(up))
    r = r.withColumn("_d", F.col(number) - F.lag(number).over(up)).withColumn("_n", F.count("*").over(Window.partitionBy(*group)))
    r = r.withColumn("_run", F.coalesce(F.min((F.col("_d") > jump).cast("int")).over(down), F.lit(0))).withColumn("_tail", F.col("_n") - F.col("_at") + 1)
    ok = (F.col("_n") >= fewest) & (F.col("_run") == 1) & (F.col("_tail") <= F.greatest(F.lit(3), F.floor(F.col("_n") / 100)))
    cut = r.filter(ok).groupBy(*group).agg(F.min("_at").alias("_from"))
    return r.join(cut, list(group)).filter(F.col("_at") >= F.col("_from")).groupBy(*group).agg(F.array_sort(F.collect_list(number)).alias("outliers"))


def neighbour_agreement(rows: DataFrame, group: Sequence[str], order: Sequence[str], number: str, most: int = 3) -> DataFrame:
    """rows with agrees: the number is 1 to most above the one before, or as much below the one after (nulls passed over)."""
    w = Window.partitionBy(*group).orderBy(*order)
    known = rows.filter(F.col(number).isNotNull())
    before, after = F.col(number) - F.lag(number).over(w), F.lead(number).over(w) - F.col(number)
    return known.withColumn("agrees", F.coalesce(before.between(1, most), F.lit(False)) | F.coalesce(after.between(1, most), F.lit(False)))


def record_aggregates(records: DataFrame, by: Sequence[str], provenance: Sequence[str]) -> DataFrame:
    """Counts for each group: total, male, female, with id (non-empty), invalid, duplicates, other invalid, low confidence (null: not low), mean confidence and complete provenance."""
    complete = F.lit(True)
    for c in provenance:
        complete = complete & F.col(c).isNotNull()
    invalid = ~F.coalesce("is_valid", F.lit(False))
    return records.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("gender") == "M").alias("male"),
        F.count_if(F.col("gender") == "F").alias("female"),
        F.count_if(F.coalesce("id_number", F.lit("")) != "").alias("with_id"),
        F.count_if(invalid).alias("invalid"),
        F.count_if(F.col("duplicate_kind").isNotNull()).alias("duplicates"),
        F.count_if(invalid & F.col("duplicate_kind").isNull()).alias("other_invalid"),
        F.count_if(F.col("confidence") < LOW_ROW).alias("low_confidence"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(complete).alias("provenance_complete"),
    )


def flags(total: Column, invalid: Column, low: Column, mean: Column, outliers: Column, gaps: Column, mapping: Column, historical: Column) -> Column:
    """Array of (code, level) of a station, in a fixed order."""
    flag = lambda code, level: F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))
    none = total.isNull() | (total == 0)
    is_low = (F.coalesce(mean, F.lit(0.0)) < LOW_MEAN) | (F.coalesce(low / F.nullif(total, F.lit(0)), F.lit(0.0)) > LOW_SHARE)
    rules = [
        F.when(none, flag("NO_ELECTORATE", "info")),
        F.when(~none & (invalid > 0), flag("DATA_QUALITY", "warn")),
        F.when(~none & is_low, flag("LOW_CONFIDENCE", "warn")),
        F.when(~none & (invalid == 0) & ~is_low, flag("CLEAN", "good")),
        F.when(~none & (outliers > 0), flag("SOURCE_ANOMALY", "warn")),
        F.when(~none & (gaps > 0), flag("SERIAL_GAPS", "info")),
        F.when(mapping == "verified", flag("MAPPING_VERIFIED", "good")).when(mapping == "review", flag("MAPPING_REVIEW", "warn")).otherwise(flag("NO_MAPPING", "info")),
        F.when(historical == "linked", flag("HISTORICAL_AVAILABLE", "good")).when(historical == "unlinked", flag("HISTORICAL_UNLINKED", "warn")).otherwise(flag("HISTORICAL_MISSING", "info")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def health(total: Column, invalid: Column, low: Column, provenance: Column, station_provenance: Column, mapping: Column, linked: Column) -> Column:
    """Struct of the six scores (1 decimal), their rounded sum and its band. Halves are rounded to even."""
    n = F.when(total > 0, total.cast("double"))
    part = lambda points, loss: points * F.greatest(F.lit(0.0), 1 - loss)
    scores = {
        "electorate": F.when(n.isNotNull(), 20.0).otherwise(0.0),
        "validation": F.coalesce(part(20, 10 * invalid / n), F.lit(0.0)),
        "confidence": F.coalesce(part(15, 5 * low / n), F.lit(0.0)),
        "provenance": F.coalesce(15 * provenance / n, F.when(station_provenance, 15.0).otherwise(0.0)),
        "link": F.when(linked, 15.0).otherwise(0.0),
        "mapping": F.when(mapping == "verified", 15.0).when(mapping == "review", 5.0).otherwise(0.0),
    }
    rounded = {k: F.bround(v, 1) for k, v in scores.items()}
    sum_all = F.bround(sum(rounded.values(), F.lit(0.0))).cast("int")
    band = F.when(sum_all >= 75, "Strong").when(sum_all >= 50, "Partial").otherwise("Limited")
    return F.struct(*[v.alias(k) for k, v in rounded.items()], sum_all.alias("total"), band.alias("band"))


def level_rank(level: Column) -> Column:
    """bad, warn, info, good as 0 to 3; others come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(0)) - 1, F.lit(len(LEVELS)).cast("bigint"))


def gate(n: Column, passed: Column, expected: Column, distinct: Column, fewest: int = 10, sums: float = 0.9, coverage: float = 0.9, unlike: float = 0.75) -> Column:
    """Why a result sheet isn't accepted: the first gate that it fails; null if none."""
    return (
        F.when(n < fewest, "too few rows")
        .when(F.coalesce(passed / F.nullif(n, F.lit(0)), F.lit(0.0)) < sums, "sum checks fail")
        .when(F.coalesce(n / F.nullif(expected, F.lit(0)), F.lit(0.0)) < coverage, "rows missing")
        .when(F.coalesce(distinct / F.nullif(n, F.lit(0)), F.lit(0.0)) < unlike, "repeated numbers")
    )


def share_of(n: str, d: str) -> Column:
    return percent(F.col(n), F.col(d))
