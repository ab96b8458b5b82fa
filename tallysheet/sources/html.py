"""Rows from HTML columns: links, titles, options, tables, pager numbers, embedded JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, href) of each anchor, in order."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(id_col, F.posexplode(hrefs).alias("pos", "href"))


def anchors(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, href, label) of each anchor; the label is without tags and with single spaces."""
    whole = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    a = pages.select(id_col, F.posexplode(whole).alias("pos", "_a"))
    return a.select(id_col, "pos", F.regexp_extract("_a", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1).alias("href"), plain(F.col("_a")).alias("label"))


def plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def first_by_number(found: DataFrame, page: str, number: Column) -> DataFrame:
    """Anchors with a number in the label, one for each number and page (the first), by number."""
    n = found.withColumn("number", number).filter(F.col("number").isNotNull())
    return n.withColumn("_rank", F.row_number().over(Window.partitionBy(page, "number").orderBy("pos"))).filter("_rank = 1").drop("_rank")


def hidden_fields(html: Column) -> Column:
    """Map of the names and values of hidden inputs; later ones of a name are passed over."""
    inputs = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<input\b[^>]*>"), F.lit(0)), lambda x: x.rlike(r"""(?i)type\s*=\s*["']?hidden"""))
    pairs = F.transform(inputs, lambda x: F.struct(F.regexp_extract(x, r"""(?i)\bname\s*=\s*["']([^"']*)""", 1).alias("k"), F.regexp_extract(x, r"""(?i)\bvalue\s*=\s*["']([^"']*)""", 1).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p, i: F.when(F.array_position(names, p["k"]) == i + 1, F.struct(p["k"], p["v"]))), lambda p: p.isNotNull()))


def options(html: Column) -> Column:
    """Array of (value, label) of select options without placeholders (empty, 0 or -1)."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<option\b[^>]*>.*?</option>"), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"""(?i)\bvalue\s*=\s*["']?([^"'>]*)""", 1).alias("value"), plain(x).alias("label")))
    return F.filter(pairs, lambda p: ~F.trim(p["value"]).isin("", "0", "-1"))


def table_rows(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, row, cells) of each table row; header cells count as cells."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    r = pages.select(id_col, F.posexplode(rows).alias("row", "_r"))
    cells = F.transform(F.regexp_extract_all(F.col("_r"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), plain)
    return r.select(id_col, "row", cells.alias("cells"))


def pager_numbers(html: Column) -> Column:
    """Sorted distinct page numbers that a grid's pager links to."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(?i)Page\$(\d+)"), F.lit(1)), lambda x: x.cast("int"))))


def embedded_json(html: Column, name: str, schema: str) -> Column:
    """The value of `const name = {...};` in a script, parsed; null if there is none or it doesn't parse."""
    return F.from_json(F.regexp_extract(html, rf"(?s)\b(?:const|var|let)\s+{name}\s*=\s*(\{{.*?\}}|\[.*?\])\s*;", 1), schema)


def of_year(url: Column, year: Column) -> Column:
    """A link without a year folder, or with that of the year."""
    found = F.regexp_extract(url, r"(?i)/Form20_(\d{2})/", 1)
    return (found == "") | (found == F.lpad((year % 100).cast("string"), 2, "0"))


def grid_entries(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, number, name, href) of a grid's rows: those with a number in front and a link. Header rows and the pager's row, whose links turn pages, are passed over."""
    rows = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    r = pages.select(id_col, F.explode(rows).alias("_r")).filter(~F.col("_r").rlike(r"(?i)Page\$\d"))
    cells = F.transform(F.regexp_extract_all(F.col("_r"), F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), plain)
    href = F.nullif(F.regexp_extract("_r", r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))
    out = r.select(id_col, F.get(cells, F.lit(0)).try_cast("int").alias("number"), F.get(cells, F.lit(1)).alias("name"), href.alias("href"))
    return out.filter("number is not null and href is not null")


def attributed(found: DataFrame, district_numbers: Column, label: str = "label", state_names: Column | None = None) -> DataFrame:
    """Links with the number that their label has; links for none or several numbers, and repeated (number, href), go.

    That is the only one of the district's numbers in the label. Where none is, it is the only number of state_names (a map from number to
    names) that stands in the label together with one of its names.
    """
    low = F.lower(F.col(label))
    seen = F.array_distinct(F.transform(F.regexp_extract_all(F.col(label), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")))
    hit = F.array_intersect(seen, district_numbers)
    if state_names is not None:
        named = F.filter(seen, lambda n: F.exists(F.coalesce(F.try_element_at(state_names, n), F.array().cast("array<string>")), lambda x: low.contains(F.lower(x))))
        hit = F.when(F.size(hit) == 0, named).otherwise(hit)
    return found.withColumn("_hit", hit).filter(F.size("_hit") == 1).withColumn("number", F.get("_hit", F.lit(0))).drop("_hit").dropDuplicates(["number", "href"])
