"""Workbooks from landed cells (doc, sheet, row, col, value): which sheet to read, which columns are which, candidates and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.text import squeezed

#: A polling-station number, with letters behind it or not.
STATION = r"^\d{1,4}\s*[A-Za-z]?$"


def number(x: Column) -> Column:
    """A cell's number; null if it isn't one. Grouping commas are passed over."""
    return F.regexp_replace(F.trim(x), ",", "").try_cast("double")


def cell_text(x: Column) -> Column:
    """A cell's text with single spaces; a whole number without its decimals."""
    n = F.trim(x).try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)) & F.trim(x).rlike(r"^-?\d+\.0+$"), F.floor(n).cast("string")).otherwise(squeezed(F.coalesce(x, F.lit(""))))


def sheet_of(cells: DataFrame, wanted: DataFrame, first_rows: int = 40) -> DataFrame:
    """(doc, ac, sheet): the sheet named after the constituency, else the first (by order of sheets, then name) whose first rows begin with its number and a station number.

    cells: doc, sheet, sheet_no, row, col, value. wanted: doc, ac.
    """
    named = cells.select("doc", "sheet", "sheet_no").distinct().join(wanted, "doc").filter(F.trim("sheet") == F.col("ac").cast("string"))
    named = named.select("doc", "ac", F.lit(0).alias("_by"), "sheet_no", "sheet")
    head = cells.filter((F.col("row") < first_rows) & F.col("col").isin(0, 1)).groupBy("doc", "sheet", "sheet_no", "row").agg(F.max(F.when(F.col("col") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("col") == 1, F.col("value"))).alias("b"))
    carrying = head.join(wanted, "doc").filter((number(F.col("a")) == F.col("ac")) & cell_text(F.col("b")).rlike(STATION)).select("doc", "ac", F.lit(1).alias("_by"), "sheet_no", "sheet")
    best = named.unionByName(carrying).groupBy("doc", "ac").agg(F.min(F.struct("_by", "sheet_no", "sheet")).alias("_s"))
    return best.select("doc", "ac", F.col("_s.sheet").alias("sheet"))


def readable_sheets(cells: DataFrame, wanted: DataFrame, fewest: int = 12) -> DataFrame:
    """(doc, ac, sheet): where several sheets have numbers as names, only the one of the constituency; else it, or all sheets of `fewest` rows or more."""
    s = cells.groupBy("doc", "sheet").agg((F.max("row") + 1).alias("rows")).withColumn("_numbered", F.trim("sheet").rlike(r"^\d+$"))
    j = s.join(wanted, "doc").withColumn("_own", F.trim("sheet") == F.col("ac").cast("string"))
    w = Window.partitionBy("doc", "ac")
    j = j.withColumn("_n", F.count_if("_numbered").over(w)).withColumn("_has", F.max(F.col("_own").cast("int")).over(w))
    return j.filter(F.when(F.col("_has") == 1, F.col("_own")).otherwise((F.col("_n") <= 1) & (F.col("rows") >= fewest))).select("doc", "ac", "sheet")


def station_columns(cells: DataFrame, by: Sequence[str] = ("doc", "sheet"), numbers: int = 5) -> DataFrame:
    """(by, number_col, name_col): the pair of columns that fits most rows as station number and name (the next column, or the one after a blank or 0).

    A row fits if `numbers` cells behind the name are numbers and the name isn't one. Numbers that hardly vary score nothing; ties go to the nearer name, then to the left.
    """
    rows = cells.groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct(cell_text(F.col("value")).alias("t"), number(F.col("value")).alias("n"))))).alias("m"), F.max("col").alias("last"))
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("pc"), F.lit(p + o).alias("nc")) for p in range(3) for o in (1, 2)])).alias("p")
    r = rows.select(*by, "row", "m", "last", pairs).select(*by, "m", "last", "p.pc", "p.nc")
    at = lambda c: F.try_element_at("m", c)
    text = lambda c: F.coalesce(at(c)["t"], F.lit(""))
    behind = F.size(F.filter(F.map_entries("m"), lambda e: (e["key"] > F.col("nc")) & e["value"]["n"].isNotNull()))
    fits = text(F.col("pc")).rlike(STATION) & ((F.col("nc") == F.col("pc") + 1) | text(F.col("pc") + 1).isin("", "0")) & (text(F.col("nc")) != "") & at(F.col("nc"))["n"].isNull() & (behind >= numbers)
    hits = r.filter(fits).groupBy(*by, "pc", "nc").agg(F.count("*").alias("hits"), F.countDistinct(text(F.col("pc"))).alias("distinct_numbers"))
    hits = hits.filter(F.col("distinct_numbers") * 2 > F.col("hits"))
    best = hits.groupBy(*by).agg(F.min(F.struct((-F.col("hits")).alias("n"), "nc", "pc")).alias("b"))
    return best.select(*by, F.col("b.pc").alias("number_col"), F.col("b.nc").alias("name_col"), (-F.col("b.n")).alias("rows"))


def total_column(cells: DataFrame, by: Sequence[str], candidates: Sequence[int], totals: Sequence[int]) -> DataFrame:
    """(by, total_col, matching, rows): of the possible total columns the one that the candidate columns add up to in most rows (ties: the leftmost). Rows with a missing number don't count."""
    n = number(F.col("value"))
    rows = cells.groupBy(*by, "row").agg(F.sum(F.when(F.col("col").isin(*candidates), n)).alias("s"), F.count(F.when(F.col("col").isin(*candidates), n)).alias("k"), *[F.max(F.when(F.col("col") == t, n)).alias(f"t{t}") for t in totals])
    rows = rows.filter(F.col("k") == len(candidates))
    x = rows.select(*by, "s", F.explode(F.array(*[F.struct(F.lit(t).alias("c"), F.col(f"t{t}").alias("v")) for t in totals])).alias("x"))
    m = x.filter("x.v is not null").groupBy(*by, F.col("x.c").alias("c")).agg(F.count_if(F.col("s") == F.col("x.v")).alias("matching"), F.count("*").alias("rows"))
    return m.groupBy(*by).agg(F.min(F.struct((-F.col("matching")).alias("m"), "c", "rows")).alias("b")).select(*by, F.col("b.c").alias("total_col"), (-F.col("b.m")).alias("matching"), F.col("b.rows").alias("rows"))


def until_total(rows: DataFrame, by: Sequence[str], order: str, is_total: Column) -> DataFrame:
    """rows before the first total row of each sheet."""
    seen = F.max(F.coalesce(is_total, F.lit(False)).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_seen", seen).filter("_seen = 0").drop("_seen")


def triplets(cells: DataFrame, by: Sequence[str] = ("doc", "sheet"), row: str = "row") -> DataFrame:
    """(by, row, serial, party, votes) from cells that stand in threes behind the second column: serial, party, votes."""
    c = cells.filter(F.col("col") >= 2).select(*by, row, F.floor((F.col("col") - 2) / 3).cast("int").alias("_i"), ((F.col("col") - 2) % 3).alias("_k"), "value")
    t = c.groupBy(*by, row, "_i").agg(F.max(F.when(F.col("_k") == 0, number(F.col("value")))).cast("int").alias("serial"), F.max(F.when(F.col("_k") == 1, cell_text(F.col("value")))).alias("party"), F.max(F.when(F.col("_k") == 2, number(F.col("value")))).cast("long").alias("votes"))
    return t.filter(F.col("votes").isNotNull()).drop("_i")


def numbered_header(x: Column) -> Column:
    """Struct of number and name of a header such as `3&name` or `3. name`; null where there is no number."""
    p = r"^\s*(\d+)\s*[.)&-]\s*(.*)$"
    n = F.regexp_extract(x, p, 1).try_cast("int")
    return F.when(n.isNotNull(), F.struct(n.alias("number"), squeezed(F.regexp_extract(x, p, 2)).alias("name")))


def renamed(x: Column, aliases: Mapping[str, Sequence[str]]) -> Column:
    """The field that a header names, by its aliases (without case and white space); null for others."""
    key = F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", ""))
    out = F.lit(None).cast("string")
    for field, names in aliases.items():
        out = F.when(key.isin(*["".join(n.lower().split()) for n in names]), field).otherwise(out)
    return out


def vowel_share(names: DataFrame, by: Sequence[str], name: str = "name") -> DataFrame:
    """The share of vowels among the ASCII letters of a sheet's names: names typed for a legacy font have few."""
    letters = F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z]", "")
    vowels = F.length(letters) - F.length(F.regexp_replace(letters, "(?i)[aeiou]", ""))
    return names.groupBy(*by).agg((F.sum(vowels) / F.greatest(F.sum(F.length(letters)), F.lit(1))).alias("vowel_share"))


def candidate_names(names: DataFrame, by: Sequence[str], position: str, name: str = "name") -> DataFrame:
    """names cleaned (numbering before and stray marks around them dropped); blank ones are `Candidate` and their position."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s*\d+\s*[.)&-]\s*", "")
    clean = F.trim(squeezed(clean), F.lit(" ~`,;"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(position))
    return names.withColumn("_at", at).withColumn(name, F.when(clean == "", F.concat(F.lit("Candidate "), F.col("_at"))).otherwise(clean)).drop("_at")


def block_check(rows: DataFrame, by: Sequence[str], blocks: DataFrame) -> DataFrame:
    """For each block of a report (by, printed_total): row_mismatch if general and postal votes aren't a candidate's total, total_mismatch if the candidates don't add up to the printed total, empty without candidates, else ok."""
    wrong = F.col("general").isNotNull() & F.col("postal").isNotNull() & (F.col("general") + F.col("postal") != F.coalesce("total", F.lit(-1)))
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(wrong), F.lit(False)).alias("_wrong"), F.coalesce(F.sum("total"), F.lit(0)).alias("sum_total"))
    out = blocks.join(g, list(by), "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sum_total": F.coalesce("sum_total", F.lit(0))})
    status = F.when(F.coalesce("_wrong", F.lit(False)), "row_mismatch").when(F.col("printed_total").isNotNull() & (F.col("printed_total") != F.col("sum_total")), "total_mismatch").when(F.col("n") == 0, "empty").otherwise("ok")
    return out.withColumn("status", status).drop("_wrong")


def header_fields(pages: DataFrame, fields: Mapping[str, str], text: str = "text") -> DataFrame:
    """pages with a column for each field: the first group of its pattern in the text, trimmed; null where it doesn't match."""
    return pages.withColumns({k: F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit("")) for k, p in fields.items()})
