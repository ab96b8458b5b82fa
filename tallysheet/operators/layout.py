"""Tables on pages, from landed words (doc, page, x0, y0, x1, y1, text) and ruling lines: bounds, columns, rows, copies and gates.

A page is small, so windows are by page. Where a rule depends on the order in which words were kept, a page is one Arrow group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc", "page")


def page_bounds(words: DataFrame, marker: Column, footnote: Column, top: float, bottom: float, page: Sequence[str] = PAGE, below: float = 12, above: float = 4) -> DataFrame:
    """For each page where the table's body begins and ends: `below` under the lowest marker, `above` over the first footnote under that; top and bottom where there is none."""
    w = words.withColumn("_m", F.max(F.when(marker, F.col("y0"))).over(Window.partitionBy(*page)))
    w = w.withColumn("_top", F.coalesce(F.col("_m") + below, F.lit(float(top))))
    first = F.min(F.when(footnote & (F.col("y0") > F.col("_top")), F.col("y0") - above))
    return w.groupBy(*page).agg(F.max("_top").alias("top"), F.least(F.coalesce(first, F.lit(float(bottom))), F.lit(float(bottom))).alias("bottom"))


def column_of(x: Column, columns: Sequence[tuple[str, float, float]]) -> Column:
    """The name of the first interval [from, to) that has x; null outside all."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(columns):
        out = F.when((x >= lo) & (x < hi), name).otherwise(out)
    return out


def visual_words(words: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Words as they are seen: overprints (the same text within a third of a dozen points) once, digits printed four times over once, and a serial that is joined to the next word by -, & or . as two words."""
    t = words.withColumn("text", F.trim("text")).filter("text <> ''")
    near = Window.partitionBy(*page, "text", F.bround(F.col("x0") / 3), F.bround(F.col("y0") / 3)).orderBy("y0", "x0", "x1", "y1")
    t = t.withColumn("_k", F.row_number().over(near)).filter("_k = 1").drop("_k")
    t = t.withColumn("text", F.regexp_replace("text", r"^(\d{1,3})\1{3}$", "$1"))
    serial = F.regexp_extract("text", r"^(\d{1,3})[-&.](.*)$", 1)
    rest = F.regexp_extract("text", r"^(\d{1,3})[-&.](.*)$", 2)
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.length(serial) + 1) / F.length("text")
    whole = F.array(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"), F.col("text").alias("t")))
    both = F.array(F.struct(F.col("x0").alias("a"), cut.alias("b"), serial.alias("t")), F.struct(cut.alias("a"), F.col("x1").alias("b"), rest.alias("t")))
    parts = F.when(serial == "", whole).otherwise(F.filter(both, lambda x: F.trim(x["t"]) != ""))
    other = [c for c in words.columns if c not in ("x0", "x1", "text")]
    return t.select(*other, F.explode(parts).alias("_p")).select(*other, F.col("_p.a").alias("x0"), F.col("_p.b").alias("x1"), F.col("_p.t").alias("text"))


def without_overlaps(words: DataFrame, page: Sequence[str] = PAGE, share: float = 0.5) -> DataFrame:
    """Words but for those that a word kept before (by top, then left) covers by more than that share of their own area: patches over an original row."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["y0", "x0", "x1", "y1", "text"], kind="stable")
        kept: list[tuple] = []
        at = []
        for i, (a, b, c, d) in enumerate(zip(p["x0"], p["y0"], p["x1"], p["y1"], strict=True)):
            area = max((c - a) * (d - b), 1e-6)
            if not any(max(0, min(c, z) - max(a, x)) * max(0, min(d, u) - max(b, y)) > share * area for x, y, z, u in kept):
                kept.append((a, b, c, d))
                at.append(i)
        return p.iloc[at]

    return words.groupBy(*page).applyInPandas(run, words.schema)


def header_positions(words: DataFrame, first_row: Column, keys: Mapping[str, Sequence[str]], page: Sequence[str] = PAGE) -> DataFrame:
    """(page, key, centres): the middles of words above the first row that contain a spelling of the key, from left to right."""
    hits = F.filter(F.array(*[F.when(_any(F.col("text"), spelt), F.lit(k)) for k, spelt in keys.items()]), lambda x: x.isNotNull())
    w = words.filter(F.col("y0") < first_row).select(*page, F.explode(hits).alias("key"), ((F.col("x0") + F.col("x1")) / 2).alias("_x"))
    return w.groupBy(*page, "key").agg(F.array_sort(F.collect_list("_x")).alias("centres"))


def _any(x: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def named_columns(headers: DataFrame, columns: DataFrame, sheet: Sequence[str], most: float = 45) -> DataFrame:
    """(sheet, column, key): each header key gets at most one column and each column one key, the nearest pairs first (ties: by key, then column), none further than `most`.

    headers: sheet, key, x; columns: sheet, column, x. The pairs of a sheet are a few dozen: they are settled in one group.
    """
    pairs = headers.select(*sheet, "key", F.col("x").alias("_hx")).join(columns.select(*sheet, "column", F.col("x").alias("_cx")), list(sheet))
    pairs = pairs.withColumn("_d", F.abs(F.col("_hx") - F.col("_cx"))).filter(F.col("_d") <= most)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        keys, cols, at = set(), set(), []
        for i, (k, c) in enumerate(zip((p := p.sort_values(["_d", "key", "column"], kind="stable"))["key"], p["column"], strict=True)):
            if k not in keys and c not in cols:
                keys.add(k)
                cols.add(c)
                at.append(i)
        return p.iloc[at][[*sheet, "column", "key"]]

    schema = type(pairs.schema)([pairs.schema[c] for c in (*sheet, "column", "key")])
    return pairs.groupBy(*sheet).applyInPandas(run, schema)


def label_line(words: DataFrame, page: Sequence[str] = PAGE, labels: int = 10, near: float = 14, fewest: int = 8) -> DataFrame:
    """(page, label, centre, below): the header line with most of the labels 1 to `labels`; the topmost word of each label counts. No rows where under `fewest` are found.

    below is the bottom of the line's own labels. Of lines with as many labels the one of the highest word is taken.
    """
    m = words.filter(F.trim("text").isin(*[str(i) for i in range(1, labels + 1)])).withColumn("label", F.trim("text").cast("int"))
    seed = m.select(*page, F.col("y0").alias("_at"), F.col("x0").alias("_ax")).distinct()
    band = seed.join(m, list(page)).filter(F.abs(F.col("y0") - F.col("_at")) < near)
    n = band.groupBy(*page, "_at", "_ax").agg(F.countDistinct("label").alias("_n"))
    best = n.filter(F.col("_n") >= fewest).groupBy(*page).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_at", "_ax")).alias("_b")).select(*page, F.col("_b._at").alias("_y"))
    own = m.join(best, list(page)).filter(F.abs(F.col("y0") - F.col("_y")) < near)
    top = own.groupBy(*page, "label").agg(F.min(F.struct("y0", "x0", "x1", "y1")).alias("_t"))
    return top.select(*page, "label", ((F.col("_t.x0") + F.col("_t.x1")) / 2).alias("centre"), F.max("_t.y1").over(Window.partitionBy(*page)).alias("below"))


def filled_labels(found: Column, columns: Column, labels: int = 10) -> Column:
    """A map label -> column, completed: on a grid of as many columns as labels where each found label has its own column, all have; else a missing label takes the column behind that of the label before it, if no label has that."""
    own = F.forall(F.map_entries(found), lambda e: e["key"] == e["value"])
    whole = F.map_from_arrays(F.sequence(F.lit(1), F.lit(labels)), F.sequence(F.lit(1), F.lit(labels)))

    def step(m: Column, n: Column) -> Column:
        behind = F.try_element_at(m, n - 1) + 1
        free = ~F.map_contains_key(m, n) & behind.isNotNull() & ~F.array_contains(F.map_values(m), F.coalesce(behind, F.lit(-1)))
        return F.when(free, F.map_concat(m, F.map_from_arrays(F.array(n), F.array(behind)))).otherwise(m)

    return F.when((columns == labels) & own, whole).otherwise(F.aggregate(F.sequence(F.lit(2), F.lit(labels)), found, step))


def fits_grid(rules: Column, grid: Column, near: float = 3, lacking: int = 2) -> Column:
    """Whether each of a page's rules is one of the grid's, and at most so many are lacking."""
    return (F.size(rules) >= F.size(grid) - lacking) & F.forall(rules, lambda x: F.exists(grid, lambda y: F.abs(x - y) <= near))


def ruling_lines(shapes: DataFrame, page: Sequence[str] = PAGE, thin: float = 2, long: float = 20) -> DataFrame:
    """(page, direction, at): upright and level rules from drawn boxes (x0, y0, x1, y1) that are thin one way and long the other, to whole points, each once."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    kind = F.when((w < thin) & (h > long), "upright").when((h < thin) & (w > long), "level")
    return shapes.select(*page, kind.alias("direction"), F.bround(F.when(kind == "upright", F.col("x0")).otherwise(F.col("y0"))).cast("int").alias("at")).filter("direction is not null").distinct()


def bands(lines: DataFrame, page: Sequence[str] = PAGE, at: str = "at", least: float = 45) -> DataFrame:
    """(page, top, bottom) between neighbouring level lines that are `least` apart or more."""
    after = F.lead(at).over(Window.partitionBy(*page).orderBy(at))
    return lines.withColumn("bottom", after).select(*page, F.col(at).alias("top"), "bottom").filter(F.col("bottom") - F.col("top") >= least)


def in_bands(words: DataFrame, rows: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Words with the top of the band that has their own top, [top, bottom): bands and words are sorted together, no pair is made. Words in no band are left out."""
    b = rows.select(*page, F.col("top").cast("double").alias("_y"), F.col("bottom").cast("double").alias("_bottom"), F.lit(0).alias("_word"))
    both = words.withColumn("_y", F.col("y0").cast("double")).withColumn("_word", F.lit(1)).unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*page).orderBy("_y", "_word").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_word") == 0, F.struct("_y", "_bottom")), ignorenulls=True).over(w)
    return both.withColumn("_b", last).filter((F.col("_word") == 1) & (F.col("_y") < F.col("_b._bottom"))).select(*words.columns, F.col("_b._y").alias("row_top"))


def column_ranges(edges: DataFrame, headers: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """(page, key, lo, hi): the rules (at) next to each header's x on its left and right; null where there is none."""
    j = headers.select(*page, "key", "x").join(edges.select(*page, "at"), list(page), "left")
    return j.groupBy(*page, "key").agg(F.max(F.when(F.col("at") < F.col("x"), F.col("at"))).alias("lo"), F.min(F.when(F.col("at") > F.col("x"), F.col("at"))).alias("hi"))


def template_shift(found: DataFrame, template: Sequence[float], doc: Sequence[str] = ("doc",), near: float = 15, fewest: int = 3) -> DataFrame:
    """(doc, shift, agreeing): the shift that lays most of a template's rules within `near` of found ones (at); ties go to the leftmost found rule, then to the template's first. None under `fewest`."""
    t = F.array(*[F.lit(float(x)) for x in template])
    per = found.groupBy(*doc).agg(F.array_sort(F.collect_set(F.col("at").cast("double"))).alias("_f"))
    shifts = F.array_distinct(F.flatten(F.transform("_f", lambda f: F.transform(t, lambda x: f - x))))
    s = per.select(*doc, "_f", F.posexplode(shifts).alias("_i", "shift"))
    s = s.withColumn("agreeing", F.size(F.filter(t, lambda x: F.exists("_f", lambda f: F.abs(x + F.col("shift") - f) <= near))))
    best = s.groupBy(*doc).agg(F.min(F.struct((-F.col("agreeing")).alias("n"), "_i", "shift")).alias("_b"))
    return best.select(*doc, F.col("_b.shift").alias("shift"), (-F.col("_b.n")).alias("agreeing")).filter(F.col("agreeing") >= fewest)


def merged_copies(rows: DataFrame, by: Sequence[str], value: str, confidence: str, text: str) -> DataFrame:
    """One row for each key of its copies: one with a value first, then of higher confidence, then of longer text. Copies that disagree on the value have none."""
    order = Window.partitionBy(*by).orderBy(F.col(value).isNull().cast("int"), F.desc(confidence), F.desc(F.length(F.coalesce(text, F.lit("")))), F.asc_nulls_last(value), F.asc(text))
    w = Window.partitionBy(*by)
    r = rows.withColumn("_k", F.row_number().over(order)).withColumn("_lo", F.min(value).over(w)).withColumn("_hi", F.max(value).over(w)).filter("_k = 1")
    return r.withColumn(value, F.when(F.col("_lo") == F.col("_hi"), F.col(value))).drop("_k", "_lo", "_hi")


def list_gate(lists: DataFrame, by: Sequence[str], number: str, count: str, coverage: float = 0.9, with_counts: float = 0.9, absent: float = 0.05, fewest: int = 10) -> DataFrame:
    """For each list: rows, coverage of its own range of numbers, rows with a count, and whether it is taken: whole, without counts (they are nearly all absent), or not."""
    g = lists.groupBy(*by).agg(F.count("*").alias("n"), (F.count("*") / (F.max(number) - F.min(number) + 1)).alias("coverage"), F.count(count).alias("counted"))
    few = F.col("counted") <= absent * F.col("n")
    bad = (F.col("n") < fewest) | (F.col("coverage") < coverage) | ~((F.col("counted") >= with_counts * F.col("n")) | few)
    return g.withColumn("verdict", F.when(F.coalesce(bad, F.lit(True)), "refused").when(few, "without counts").otherwise("whole"))


def expected_booths(labels: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """The highest number of a sheet's labels, and one for each distinct auxiliary label (a number with letters behind it)."""
    d = labels.select(*by, F.upper(F.trim(label)).alias("_l")).distinct()
    number, suffix = F.regexp_extract("_l", r"^(\d+)\s*([A-Z]*)$", 1).try_cast("int"), F.regexp_extract("_l", r"^(\d+)\s*([A-Z]*)$", 2)
    return d.groupBy(*by).agg((F.coalesce(F.max(number), F.lit(0)) + F.count_if(suffix != "")).cast("long").alias("expected"))


def total_rows(rows: DataFrame, by: Sequence[str], order: str, kind: str = "kind", after: Sequence[str] = ("postal", "etpbs")) -> DataFrame:
    """(by, evm, grand): where the first total row stands before any of the kinds `after`, and the first behind one."""
    seen = F.max(F.col(kind).isin(*after).cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    r = rows.withColumn("_seen", seen)
    total = F.col(kind) == "total"
    return r.groupBy(*by).agg(F.min(F.when(total & (F.col("_seen") == 0), F.col(order))).alias("evm"), F.min(F.when(total & (F.col("_seen") == 1), F.col(order))).alias("grand"))


def over_read_columns(rows: DataFrame, totals: DataFrame, by: Sequence[str], votes: str = "votes") -> DataFrame:
    """Columns (pos, from 0) of a sheet that add up to more than the printed total row has for them: (by, pos, column_sum, printed)."""
    s = rows.select(*by, F.posexplode(votes).alias("pos", "_v")).groupBy(*by, "pos").agg(F.sum("_v").alias("column_sum"))
    p = totals.select(*by, F.posexplode(votes).alias("pos", "printed"))
    return s.join(p, [*by, "pos"]).filter("column_sum > printed")


def confirmed_labels(rows: DataFrame, by: Sequence[str], order: str, label: str = "label", serial: str = "serial") -> DataFrame:
    """rows with confirmed: the label's number is one more than the one before or one less than the one behind, is the same with an auxiliary suffix, or is the printed serial; labels that stand twice are none."""
    w = Window.partitionBy(*by).orderBy(order)
    pattern = r"^(\d+)\s*([A-Z]*)$"
    r = rows.withColumn("_l", F.upper(F.trim(label)))
    r = r.withColumn("_n", F.regexp_extract("_l", pattern, 1).try_cast("int")).withColumn("_s", F.regexp_extract("_l", pattern, 2))
    r = r.withColumn("_b", F.lag("_n").over(w)).withColumn("_a", F.lead("_n").over(w)).withColumn("_sa", F.lead("_s").over(w)).withColumn("_k", F.count("*").over(Window.partitionBy(*by, "_l")))
    steps = (F.col("_n") - F.col("_b") == 1) | (F.col("_a") - F.col("_n") == 1) | ((F.col("_s") != "") & (F.col("_n") == F.col("_b"))) | ((F.col("_sa") != "") & (F.col("_n") == F.col("_a"))) | (F.col("_n") == F.col(serial))
    return r.withColumn("confirmed", F.coalesce(F.col("_n").isNotNull() & (F.col("_k") == 1) & steps, F.lit(False))).drop("_l", "_n", "_s", "_b", "_a", "_sa", "_k")


def is_caption(cells: Sequence[Column], pattern: str, short: int = 30, fewest: int = 2) -> Column:
    """Whether so many cells of a row are short and match the captions' pattern: a header that is repeated on every page."""
    hits = [(F.coalesce(c.rlike(pattern), F.lit(False)) & (F.length(c) < short)).cast("int") for c in cells]
    return sum(hits[1:], hits[0]) >= fewest


def read_serial(x: Column, most: int = 3) -> Column:
    """The digits of a text, Devanagari ones too, as a number; null if there are none or more than `most`."""
    digits = F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), "०१२३४५६७८९", "0123456789"), r"[^0-9]", "")
    return F.when(F.length(digits).between(1, most), digits.try_cast("int"))


def village_terms(x: Column) -> Column:
    """The village names of a header, in order and each once: split at commas, numbers before a name dropped, names with other than Devanagari letters passed over."""
    names = F.transform(F.split(F.coalesce(x, F.lit("")), "[,،]"), lambda t: F.trim(F.regexp_replace(t, r"^[\s0-9०-९.\-]+", "")))
    return F.array_distinct(F.filter(names, lambda t: (t != "") & ~t.rlike(r"[^\x{0900}-\x{097F}\s]")))


def mean_confidence(pages: DataFrame, by: Sequence[str], words: str = "words", confidence: str = "confidence") -> DataFrame:
    """The mean confidence of pages that have words (4 decimals, half to even); 0 where none has."""
    return pages.groupBy(*by).agg(F.coalesce(F.bround(F.avg(F.when(F.col(words) > 0, F.col(confidence))), 4), F.lit(0.0)).alias("mean_confidence"))


def font_vote(pages: DataFrame, by: Sequence[str], first: str, second: str, text: str = "text") -> DataFrame:
    """Which of two fonts a document is in, by how often its glyphs stand in it: B if the second's are more, else A."""
    n = lambda glyphs: F.coalesce(F.sum(F.length(text) - F.length(F.translate(text, glyphs, ""))), F.lit(0))
    return pages.groupBy(*by).agg(F.when(n(second) > n(first), "B").otherwise("A").alias("font"))
