"""Rolls and lists summed up: statistics and their text, coverage of numbering, over-read columns, and the mapping table of a constituency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.operators.overview import STATUS_LABELS, status_label
from tallysheet.operators.quality import LOW_ROW

#: Age bands, both ends included.
AGE_BANDS = {"18-25": (18, 25), "26-40": (26, 40), "41-60": (41, 60), "61+": (61, 200)}


def _mean(x: Column | str) -> Column:
    """To 4 decimals, half to even; 0.0 without values. Summed as decimals, so that a half doesn't depend on the order of rows."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.bround(F.avg(x.cast("decimal(18,9)")), 4).cast("double"), F.lit(0.0))


def roll_stats(records: DataFrame, by: Sequence[str], official: str = "official") -> DataFrame:
    """Statistics of each roll, in one aggregation.

    records: gender, age, serial, id_number, confidence, is_valid, duplicate_kind, and the roll's official count (null or 0:
    unknown). Gaps run from the least serial to the official count, else to the greatest; serials beyond are outliers. An
    age outside all bands is in none, and isn't missing. The difference is null without an official count.
    """
    known = F.nullif(F.col(official), F.lit(0))
    within = F.when(known.isNull() | (F.col("serial") <= known), F.col("serial"))
    n, top, first = F.count("*"), F.coalesce(F.max(known), F.max("serial")), F.min("serial")
    pct = F.round((n - F.max(known)) * F.lit(100.0) / F.max(known), 4)
    return records.groupBy(*by).agg(
        n.alias("n"),
        F.count_if(F.col("gender") == "M").alias("male"),
        F.count_if(F.col("gender") == "F").alias("female"),
        F.count_if(~F.coalesce("gender", F.lit("")).isin("M", "F")).alias("other"),
        *[F.count_if(F.col("age").between(*b)).alias(f"age_{k.replace('-', '_').replace('+', '_up')}") for k, b in AGE_BANDS.items()],
        F.count_if(F.col("age").isNull()).alias("age_missing"),
        first.alias("min_serial"),
        F.max("serial").alias("max_serial"),
        F.greatest(F.coalesce(top - first + 1, F.lit(0)) - F.countDistinct(within), F.lit(0)).alias("n_gaps"),
        F.count_if(F.col("serial") > known).alias("n_outliers"),
        F.count_if(F.coalesce("id_number", F.lit("")) != "").alias("with_id"),
        F.max(known).alias("official"),
        (n - F.max(known)).alias("difference"),
        pct.alias("diff_pct"),
        _mean("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") < LOW_ROW).alias("low_confidence"),
        F.count_if(~F.coalesce("is_valid", F.lit(False))).alias("invalid"),
        F.count_if(F.col("duplicate_kind").isNotNull()).alias("duplicates"),
    )


def roll_text(title: Column) -> Column:
    """The statistics of roll_stats as lines of text under a title; lines that don't apply are left out."""
    num = lambda label, c: F.format_string(f"{label:<18}%,10d", F.col(c).cast("long"))
    bands = []
    for k in AGE_BANDS:
        c = F.col(f"age_{k.replace('-', '_').replace('+', '_up')}")
        bands.append(F.format_string(f"  {k:<6} %,6d  (%5.1f%%)", c, F.coalesce(F.bround(c * 100.0 / F.nullif(F.col("n"), F.lit(0)), 1), F.lit(0.0))))
    return F.concat_ws(
        "\n",
        title,
        num("Extracted:", "n"),
        num("  Male:", "male"),
        num("  Female:", "female"),
        num("  Other:", "other"),
        *bands,
        F.when(F.col("age_missing") > 0, F.format_string("  n/a    %,6d", "age_missing")),
        F.concat(F.lit("Serials: "), "min_serial", F.lit("-"), "max_serial", F.lit(", gaps: "), "n_gaps", F.when(F.col("n_outliers") > 0, F.concat(F.lit(", stray: "), "n_outliers")).otherwise("")),
        F.when(F.col("official").isNotNull(), num("Official:", "official")).otherwise("Official:            unknown"),
        F.when(F.col("difference").isNotNull(), F.concat(F.lit("Difference: "), F.when(F.col("difference") >= 0, "+").otherwise(""), F.col("difference").cast("string"))).otherwise("Difference: n/a"),
        num("Failing checks:", "invalid"),
        num("Duplicates:", "duplicates"),
    )


def serial_coverage(rows: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Rows of a list for each number of its own range: a list that has only a run of the numbers isn't short. 0.0 without numbers."""
    span = F.max(number) - F.min(number) + 1
    return rows.groupBy(*by).agg(F.count(number).alias("n"), F.coalesce(F.count(number) / span, F.lit(0.0)).alias("coverage"))


def list_gate(coverage: Column, stations: Column, missing: Column, least: float = 0.9, most_missing: float = 0.1) -> Column:
    """Why a list isn't taken: too few of its own numbers, or too many stations without a row; null if it is."""
    return F.when(coverage < least, "numbers missing").when(missing > most_missing * stations, "stations missing")


def over_read(rows: DataFrame, totals: DataFrame, by: Sequence[str], votes: str = "votes") -> DataFrame:
    """For each sheet, the columns (from 0) whose read votes add up to more than the printed total. Sheets without a total, or without such a column, have no row."""
    read = rows.select(*by, F.posexplode(votes).alias("col", "_v")).groupBy(*by, "col").agg(F.sum("_v").alias("_sum"))
    printed = totals.select(*by, F.posexplode(votes).alias("col", "_total"))
    return read.join(printed, [*by, "col"]).filter("_sum > _total").groupBy(*by).agg(F.array_sort(F.collect_list("col")).alias("columns"))


def mean_confidence(pages: DataFrame, by: Sequence[str], words: str = "words", confidence: str = "confidence") -> DataFrame:
    """Mean over the pages that have words, to 4 decimals; 0.0 if none has."""
    return pages.groupBy(*by).agg(_mean(F.when(F.col(words) > 0, F.col(confidence))).alias("mean_confidence"))


def mapping_table(mappings: DataFrame, parts: DataFrame) -> DataFrame:
    """What a constituency's old parts are now: a row for each mapping, and one for each old part without any.

    mappings: hist_ac, hist_part, status, to_part, linked_part, linked_station, linked_name, reason, and suggestions, an array of
    (part, station, name). parts: hist_ac, hist_part; only those of constituencies that have a mapping are listed. A
    verified mapping without a station is for review; a single suggestion names its station. rank is the order of labels.
    """
    said = status_label(F.col("status"))
    label = F.when((said == STATUS_LABELS[0]) & F.col("linked_station").isNull(), STATUS_LABELS[1]).otherwise(said)
    m = mappings.withColumn("label", label)
    verified, review = F.col("label") == STATUS_LABELS[0], F.col("label") == STATUS_LABELS[1]
    some = F.size(F.coalesce("suggestions", F.array().cast(mappings.schema["suggestions"].dataType)))
    one = F.when(review & (some == 1), F.get("suggestions", F.lit(0)))
    possible = F.concat(F.lit("Possible: Part "), F.array_join(F.transform("suggestions", lambda s: s["part"].cast("string")), ", "))
    to_part = F.coalesce(F.col("to_part").cast("string"), F.lit("-"))
    listed = m.select(
        "hist_ac",
        "hist_part",
        "label",
        F.when(verified, F.concat(F.lit("Part "), "linked_part")).when(review & (some > 0), possible).alias("current_part"),
        F.when(verified, F.col("linked_station")).otherwise(one["station"]).alias("current_station"),
        F.when(verified, F.col("linked_name")).otherwise(one["name"]).alias("current_area"),
        F.when(review, F.concat(F.lit("New roll: Part "), to_part, F.lit(". "), F.coalesce("reason", F.lit("")))).otherwise(F.col("reason")).alias("note"),
    )
    rest = parts.select("hist_ac", "hist_part").join(mappings.select("hist_ac").distinct(), "hist_ac", "left_semi").join(mappings, ["hist_ac", "hist_part"], "left_anti")
    rest = rest.select("hist_ac", "hist_part", F.lit(STATUS_LABELS[2]).alias("label"), F.lit("No mapping is loaded for this part.").alias("note"))
    return listed.unionByName(rest, allowMissingColumns=True).withColumn("rank", F.array_position(F.array(*map(F.lit, STATUS_LABELS)), F.col("label")))
