"""Geometry of words and lists, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallysheet.operators import layout

WORDS = "doc string, page int, x0 double, y0 double, x1 double, y1 double, text string"


def words(spark, *rows):
    return spark.createDataFrame([("d", 1, *map(float, r[:4]), r[4]) for r in rows], WORDS)


def test_bounds_and_columns(spark):
    w = words(spark, (0, 50, 5, 60, "(1)"), (9, 52, 15, 60, "(2)"), (0, 90, 9, 99, "* note"), (0, 20, 9, 30, "* head"), (40, 95, 50, 99, "* far"))
    b = layout.page_bounds(w, F.col("text").isin("(1)", "(2)"), F.col("text").startswith("*") & (F.col("x0") < 30), 30, 200).first()
    assert (b["top"], b["bottom"]) == (64.0, 86.0)
    none = layout.page_bounds(w.filter("y0 < 0 or y0 = 20"), F.lit(False), F.lit(False), 30, 200).first()
    assert (none["top"], none["bottom"]) == (30.0, 200.0)
    at = w.select(layout.column_of(F.col("x0"), [("a", 0, 9), ("b", 9, 30)]).alias("c")).collect()
    assert [r["c"] for r in at] == ["a", "b", "a", "a", None]


def test_visual_words(spark):
    w = words(spark, (0, 0, 8, 9, "18181818"), (0.2, 0.2, 8, 9, "18181818"), (10, 0, 20, 9, "18-abc"), (30, 0, 40, 9, " "), (50, 0, 60, 9, "7."))
    got = sorted((r["text"], round(r["x0"], 2), round(r["x1"], 2)) for r in layout.visual_words(w).collect())
    assert got == [("18", 0.0, 8.0), ("18", 10.0, 15.0), ("7", 50.0, 60.0), ("abc", 15.0, 20.0)]


def test_overlaps(spark):
    w = words(spark, (0, 0, 10, 10, "a"), (1, 1, 10, 10, "patch"), (8, 0, 20, 10, "b"), (0, 0, 10, 10, "a"))
    assert sorted(r["text"] for r in layout.without_overlaps(w).collect()) == ["a", "b"]
    assert layout.without_overlaps(w.limit(0)).count() == 0


def test_headers(spark):
    w = words(spark, (0, 0, 10, 5, "Total votes"), (20, 0, 30, 5, "NOTA"), (40, 90, 50, 95, "Total"))
    got = {r["key"]: list(r["centres"]) for r in layout.header_positions(w, F.lit(50), {"total": ("Total", "TOTAL"), "nota": ("NOTA",)}).collect()}
    assert got == {"total": [5.0], "nota": [25.0]}
    h = spark.createDataFrame([("s", "a", 10.0), ("s", "b", 14.0), ("s", "c", 300.0)], "sheet string, key string, x double")
    c = spark.createDataFrame([("s", 0, 12.0), ("s", 1, 15.0), ("s", 2, 40.0)], "sheet string, column int, x double")
    # b-1 is nearest (1), then a-0 (2); b-2 and c have nothing left within reach.
    assert {(r["column"], r["key"]) for r in layout.named_columns(h, c, ["sheet"]).collect()} == {(1, "b"), (0, "a")}


def test_label_line(spark):
    line = [(10 * i, 100 + i % 3, 10 * i + 4, 108, str(i)) for i in range(1, 10)]
    w = words(spark, *line, (10, 112, 14, 118, "1"), (95, 300, 99, 308, "10"))
    got = {r["label"]: (r["centre"], r["below"]) for r in layout.label_line(w).collect()}
    assert got == {i: (10.0 * i + 2, 108.0) for i in range(1, 10)}
    assert layout.label_line(w.filter("x0 < 60")).count() == 0
    m = lambda **k: F.create_map(*[F.lit(int(x)) for kv in k.items() for x in (kv[0][1:], kv[1])])
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(layout.filled_labels(m(_1=1, _2=2, _9=9), F.lit(10))) == {i: i for i in range(1, 11)}
    assert one(layout.filled_labels(m(_1=0, _3=2, _5=3), F.lit(9))) == {1: 0, 2: 1, 3: 2, 5: 3, 6: 4, 7: 5, 8: 6, 9: 7, 10: 8}
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(layout.fits_grid(a(10, 22), a(9, 20, 50, 70))) and not one(layout.fits_grid(a(10, 30), a(9, 20, 50))) and not one(layout.fits_grid(a(9), a(9, 20, 50, 70)))


def test_rules_and_bands(spark):
    s = spark.createDataFrame([("d", 1, 5.2, 0.0, 5.9, 90.0), ("d", 1, 5.0, 0.0, 5.4, 80.0), ("d", 1, 0.0, 30.0, 90.0, 30.5), ("d", 1, 0.0, 0.0, 9.0, 9.0)], "doc string, page int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["direction"], r["at"]) for r in layout.ruling_lines(s).collect()} == {("upright", 5), ("level", 30)}
    lines = spark.createDataFrame([("d", 1, y) for y in (0, 50, 60, 200)], "doc string, page int, at int")
    b = layout.bands(lines)
    assert {(r["top"], r["bottom"]) for r in b.collect()} == {(0, 50), (60, 200)}
    w = words(spark, (0, 0, 1, 1, "a"), (0, 49, 1, 1, "b"), (0, 55, 1, 1, "gap"), (0, 60, 1, 1, "c"), (0, 60, 1, 1, "c"), (0, 250, 1, 1, "out"))
    assert sorted((r["text"], r["row_top"]) for r in layout.in_bands(w, b).collect()) == [("a", 0.0), ("b", 0.0), ("c", 60.0), ("c", 60.0)]
    edges = spark.createDataFrame([("d", 1, x) for x in (0, 100, 200)], "doc string, page int, at int")
    heads = spark.createDataFrame([("d", 1, "k", 150), ("d", 1, "last", 250)], "doc string, page int, key string, x int")
    assert {r["key"]: (r["lo"], r["hi"]) for r in layout.column_ranges(edges, heads).collect()} == {"k": (100, 200), "last": (200, None)}


def test_template(spark):
    f = spark.createDataFrame([("d", x) for x in (30, 131, 229, 700)] + [("e", 1), ("e", 2)], "doc string, at int")
    got = [tuple(r) for r in layout.template_shift(f, (0, 100, 200, 300), near=5).collect()]
    assert [(d, n) for d, _, n in got] == [("d", 3)] and 25 <= got[0][1] <= 35


def test_copies_and_gates(spark):
    c = spark.createDataFrame([(1, None, 0.9, "long text"), (1, 5, 0.5, "a"), (2, 5, 0.9, "a"), (2, 6, 0.8, "abc"), (3, None, 0.1, None)], "n int, electors int, conf double, area string")
    assert {r["n"]: (r["electors"], r["conf"]) for r in layout.merged_copies(c, ["n"], "electors", "conf", "area").collect()} == {1: (5, 0.5), 2: (None, 0.9), 3: (None, 0.1)}
    rows = [("whole", i, 1) for i in range(20)] + [("bare", i, None) for i in range(20)] + [("half", i, 1 if i % 2 else None) for i in range(20)] + [("holes", 3 * i, 1) for i in range(20)] + [("short", i, 1) for i in range(9)]
    g = layout.list_gate(spark.createDataFrame(rows, "l string, n int, c int"), ["l"], "n", "c")
    assert {r["l"]: r["verdict"] for r in g.collect()} == {"whole": "whole", "bare": "without counts", "half": "refused", "holes": "refused", "short": "refused"}


def test_sheets(spark):
    lab = spark.createDataFrame([("s", x) for x in ("1", "2", "2A", "2a ", "7", "x", None)], "s string, label string")
    assert layout.expected_booths(lab, ["s"]).first()["expected"] == 8
    r = spark.createDataFrame([("s", i, k) for i, k in enumerate(["booth", "total", "postal", "total", "total"])] + [("t", 0, "booth")], "s string, i int, kind string")
    assert {x["s"]: (x["evm"], x["grand"]) for x in layout.total_rows(r, ["s"], "i").collect()} == {"s": (1, 3), "t": (None, None)}
    v = spark.createDataFrame([("s", [1, 5]), ("s", [2, 5])], "s string, votes array<int>")
    t = spark.createDataFrame([("s", [3, 9])], "s string, votes array<int>")
    assert [tuple(x) for x in layout.over_read_columns(v, t, ["s"]).collect()] == [("s", 1, 10, 9)]
    n = spark.createDataFrame([("s", i, x, s) for i, (x, s) in enumerate([("1", 9), ("2", 9), ("2A", 9), ("9", 9), ("40", 5), ("6", 7), ("6", 7), (None, 1)])], "s string, i int, label string, serial int")
    assert [x["confirmed"] for x in layout.confirmed_labels(n, ["s"], "i").orderBy("i").collect()] == [True, True, True, True, False, False, False, False]


@pytest.mark.parametrize(("text", "want"), [("१२", 12), (" 7.", 7), ("1234", None), ("", None), (None, None), ("x", None)])
def test_serial(spark, text, want):
    assert spark.range(1).select(layout.read_serial(F.lit(text).cast("string")).alias("x")).first()["x"] == want


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(layout.village_terms(F.lit("1 आमवाला तरला, 2 आमवाला शाx पुरम, 3 तपोवन, तपोवन,"))) == ["आमवाला तरला", "तपोवन"]
    assert one(layout.village_terms(F.lit(None).cast("string"))) == []
    cap = lambda *c: one(layout.is_caption([F.lit(x).cast("string") for x in c], "होगा|क्षेत्र"))
    assert cap("भवन होगा", "क्षेत्र", None) and not cap("होगा", "x", None) and not cap("होगा" * 20, "क्षेत्र", "")
    p = spark.createDataFrame([("a", 3, 0.5), ("a", 0, 0.1), ("b", 0, 0.9)], "d string, words int, confidence double")
    assert {r["d"]: r["mean_confidence"] for r in layout.mean_confidence(p, ["d"]).collect()} == {"a": 0.5, "b": 0.0}
    f = spark.createDataFrame([("a", "xxy"), ("a", "yy"), ("b", "xy"), ("c", None)], "d string, text string")
    assert {r["d"]: r["font"] for r in layout.font_vote(f, ["d"], "x", "y").collect()} == {"a": "B", "b": "A", "c": "A"}
