"""Landed JSON responses, cells of workbooks and words of pages as rows; review files as sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.functions import text

STATES = "stateId string, stateCd string, stateName string, stateNameHindi string, stateType string, isActive string"
DISTRICTS = "districtNo string, districtValue string, districtValueHindi string, districtCd string"
CONSTITUENCIES = "asmblyNo string, asmblyName string, asmblyNameL1 string, category string, pcNo string, acId string, districtCd string"
PARTS = "partNo string, partName string, displayName string"


def states(spark: SparkSession, path: str) -> DataFrame:
    """States that have a code and a name, by code."""
    t = spark.read.schema(STATES).json(path, multiLine=True)
    return t.filter(F.col("stateCd").isNotNull() & F.col("stateName").isNotNull()).select(text.whole_number(F.col("stateId")).alias("state_id"), F.trim("stateCd").alias("state_code"), F.trim("stateName").alias("state_name"), F.trim("stateNameHindi").alias("state_name_local")).orderBy("state_code")


def districts(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(DISTRICTS).json(path, multiLine=True)
    return t.select(text.whole_number(F.col("districtNo")).alias("district_no"), F.trim("districtCd").alias("district_code"), F.trim("districtValue").alias("district_name")).orderBy("district_code")


def constituencies(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(CONSTITUENCIES).json(path, multiLine=True)
    return t.select(text.whole_number(F.col("asmblyNo")).alias("ac_number"), F.trim("asmblyName").alias("ac_name"), F.trim("districtCd").alias("district_code")).orderBy("ac_number")


def parts(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.schema(PARTS).json(path, multiLine=True)
    return t.select(text.leading_int(F.col("partNo")).alias("part_number"), F.trim("partName").alias("part_name"))


def enveloped(responses: DataFrame, body: str, schema: str) -> DataFrame:
    """Rows of the data of responses {success, data}; a response without success fails the job."""
    r = responses.withColumn("_e", F.from_json(F.col(body), f"success boolean, data array<{schema}>"))
    ok = F.coalesce(F.col("_e.success"), F.lit(False))
    return r.withColumn("_ok", F.assert_true(ok, "a response without success")).filter(F.col("_ok").isNull()).select(F.explode("_e.data").alias("d")).select("d.*")


def resolved(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """The row of that name (case aside), else the first that contains it; empty if there is none."""
    low, w = F.lower(F.col(name)), wanted.strip().lower()
    return rows.withColumn("_rank", F.when(low == w, 0).when(low.contains(w), 1)).filter("_rank is not null").orderBy("_rank", name).limit(1).drop("_rank")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and kind (by the first bytes) of landed documents."""
    b = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "25504446", "pdf").when(head == "D0CF11E0", "xls").when(head == "504B0304", "xlsx").otherwise("other")
    return b.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"))


def is_text(pages: DataFrame, doc: str = "doc", chars: str = "chars", sample: int = 5, least: int = 100) -> DataFrame:
    """A document is text if its first pages have 100 characters on average, and mostly images if over half of them have less each."""
    w = Window.partitionBy(doc).orderBy("page")
    p = pages.withColumn("_i", F.row_number().over(w))
    return p.groupBy(doc).agg((F.avg(F.when(F.col("_i") <= sample, F.col(chars))) >= least).alias("is_text"), (F.count_if(F.col(chars) < least) * 2 > F.count("*")).alias("mostly_images"))


def best_layout(parses: DataFrame, doc: str = "doc", layout: str = "layout", matching: str = "matching", n: str = "n") -> DataFrame:
    """The parse of each document with most rows that reconcile, then most rows, then the first layout."""
    w = Window.partitionBy(doc).orderBy(F.desc(matching), F.desc(n), F.asc(layout))
    return parses.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def reading_lines(words: DataFrame, page: list[str], tolerance: float = 4.0) -> DataFrame:
    """Lines of words (x0, y0, text): words whose tops are within tolerance of the one above, by x."""
    w = Window.partitionBy(*page).orderBy("y0", "x0")
    r = words.withColumn("_new", F.when(F.col("y0") - F.lag("y0").over(w) > tolerance, 1).otherwise(0))
    r = r.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(*page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "y0", "text"))), lambda x: x["text"]), " ").alias("line_text"))


def rows_of_anchors(words: DataFrame, page: list[str], is_anchor: Column) -> DataFrame:
    """Words with the top of the last anchor at or above them; words above the first anchor are left out."""
    w = Window.partitionBy(*page).orderBy("y0", "x0").rowsBetween(Window.unboundedPreceding, 0)
    return words.withColumn("anchor_y", F.last(F.when(is_anchor, F.col("y0")), ignorenulls=True).over(w)).filter("anchor_y is not null")


def column_profile(cells: DataFrame, by: list[str]) -> DataFrame:
    """Kind of each column of a sheet: empty, const, var (numbers) or text."""
    v = F.nullif(F.trim("value"), F.lit(""))
    p = cells.groupBy(*by, "col").agg(F.count(v).alias("filled"), F.countDistinct(v).alias("distinct_values"), F.avg(text.whole_number(v).isNotNull().cast("int")).alias("number_share"))
    return p.withColumn("kind", F.when(F.col("filled") == 0, "empty").when(F.col("distinct_values") == 1, "const").when(F.col("number_share") >= 0.8, "var").otherwise("text"))


def write_review(rows: DataFrame, path: str) -> None:
    """CSV with a header, in one file; the first header begins with a byte order mark for spreadsheets. For review queues, which are short."""
    first = rows.columns[0]
    rows.withColumnRenamed(first, f"﻿{first}").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string").alias("value")).filter("value is not null").coalesce(1).write.mode("overwrite").text(path)
