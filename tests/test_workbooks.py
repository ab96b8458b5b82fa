"""Cells of workbooks, worked out by hand."""

from pyspark.sql import functions as F

from tallysheet.functions import parties
from tallysheet.sources import workbooks


def cells(spark, rows, sheet="S", no=0, doc="d"):
    return spark.createDataFrame([(doc, sheet, no, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None], "doc string, sheet string, sheet_no int, row int, col int, value string")


def test_sheets(spark):
    a = cells(spark, [["x"]] * 15, "12", 0)
    b = cells(spark, [["h", "h"], ["7", "3A"]], "Sheet2", 1)
    c = cells(spark, [["7", "4"]] * 20, "Sheet3", 2)
    all_cells = a.union(b).union(c)
    want = spark.createDataFrame([("d", 12), ("d", 7), ("d", 9)], "doc string, ac int")
    assert {r["ac"]: r["sheet"] for r in workbooks.sheet_of(all_cells, want).collect()} == {12: "12", 7: "Sheet2"}
    got = {}
    for r in workbooks.readable_sheets(all_cells, want).collect():
        got.setdefault(r["ac"], set()).add(r["sheet"])
    assert got == {12: {"12"}, 7: {"12", "Sheet3"}, 9: {"12", "Sheet3"}}
    two = all_cells.union(cells(spark, [["x"]] * 20, "13", 3))
    assert workbooks.readable_sheets(two, want.filter("ac = 9")).count() == 0


def test_station_columns(spark):
    rows = [["S.No", "PS", "", "Name"]] + [["0", str(i), "0", f"school {i}", "5", "6", "7", "8.0", "26"] for i in range(1, 9)]
    r = workbooks.station_columns(cells(spark, rows)).first()
    assert (r["number_col"], r["name_col"], r["rows"]) == (1, 3, 8)
    t = workbooks.total_column(cells(spark, rows), ["doc", "sheet"], [4, 5, 6, 7], [2, 8]).first()
    assert (t["total_col"], t["matching"], t["rows"]) == (8, 8, 8)


def test_readers(spark):
    got = workbooks.triplets(cells(spark, [["1", "ps", "1", "AB ", "1,234", "2", "CD", None]])).collect()
    assert [(r["serial"], r["party"], r["votes"]) for r in got] == [(1, "AB", 1234)]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert tuple(one(workbooks.numbered_header(F.lit("3& name  x")))) == (3, "name x") and one(workbooks.numbered_header(F.lit("name"))) is None
    assert [one(workbooks.cell_text(F.lit(x))) for x in ("7.0", " a  b ", "7.5", "1.10.0")] == ["7", "a b", "7.5", "1.10.0"]
    assert one(workbooks.renamed(F.lit(" Total  Votes"), {"total": ["TOTAL VOTES"]})) == "total" and one(workbooks.renamed(F.lit("x"), {"total": ["T"]})) is None
    r = spark.createDataFrame([("s", i, k) for i, k in enumerate(["a", "b", "total", "c"])], "s string, i int, k string")
    assert [x["k"] for x in workbooks.until_total(r, ["s"], "i", F.col("k") == "total").orderBy("i").collect()] == ["a", "b"]
    n = spark.createDataFrame([("s", 1, "1. AB  C,"), ("s", 2, " "), ("s", 3, None)], "s string, i int, name string")
    assert [x["name"] for x in workbooks.candidate_names(n, ["s"], "i").orderBy("i").collect()] == ["AB C", "Candidate 2", "Candidate 3"]
    h = workbooks.header_fields(spark.createDataFrame([("AC No : 7 Part 3",), (None,)], "text string"), {"ac": r"AC No\s*:\s*(\d+)", "none": "Z(.)"}).collect()
    assert [(x["ac"], x["none"]) for x in h] == [("7", None), (None, None)]


def test_parties(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    same = lambda a, b: one(parties.same_party(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert same("trs ", "BRS") and same("BHRS", "TRS") and same(None, "") and not same("BRS", "BHRS") and not same("TRS", "TDP")
    assert one(parties.party_name(F.lit(" x "), {"X": "The X"})) == "The X" and one(parties.party_name(F.lit(" y "), {"X": "The X"})) == "y"
