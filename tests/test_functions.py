"""Column functions and small operators against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tallysheet.functions import arrays, numbers, text
from tallysheet.operators import coverage, linkage, quality, results, search, sequence, store


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_numbers(spark):
    assert one(spark, numbers.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.rate(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, numbers.indian_grouping(F.lit(12345678))) == "1,23,45,678"
    assert [one(spark, numbers.indian_grouping(F.lit(x))) for x in (0, 999, 1000, -123456)] == ["0", "999", "1,000", "-1,23,456"]
    assert one(spark, numbers.indian_grouping(F.lit(None).cast("long"))) == numbers.DASH
    c = one(spark, numbers.change(F.lit(4), F.lit(5)))
    assert (c["delta"], c["delta_pct"], c["available"]) == (1, 25.0, True)
    assert one(spark, numbers.change(F.lit(None).cast("int"), F.lit(5)))["available"] is False
    assert one(spark, numbers.margin_bin(F.lit(50.0))) == "50%+"
    assert one(spark, numbers.margin_bin(F.lit(4.99))) == "0–5%"


def test_arrays(spark):
    v = F.array(*map(F.lit, (10, 30, 30)))
    m = one(spark, arrays.margin(v, F.lit(70)))
    assert (m["leader"], m["margin"], m["columns_with_votes"]) == (30, 0, 3)
    assert one(spark, arrays.margin(F.array(F.lit(1)), F.lit(1))) is None
    assert one(spark, arrays.margin(v, F.lit(0)))["margin_pct"] is None
    status = lambda v, t, k: one(spark, arrays.row_status(v, t, k))
    none = F.lit(None).cast("int")
    assert status(F.lit(None).cast("array<int>"), F.lit(1), none) == "not_backfilled"
    assert status(v, F.lit(70), F.lit(3)) == "ok"
    assert status(v, F.lit(70), F.lit(4)) == "check_failed"
    assert status(v, none, none) == "check_failed"
    names = F.array(*map(F.lit, "abc"))
    assert one(spark, arrays.ranked_name(names, v, 0)) is None
    assert one(spark, arrays.ranked_name(names, F.array(*map(F.lit, (10, 30, 20))), 1)) == "c"


def test_reconciled(spark):
    o = lambda *xs: F.array(*[F.array(*map(F.lit, x)) for x in xs])
    assert one(spark, arrays.reconciled(o(["12", "18"], ["30"], ["42", "45"], ["1"], ["2"], ["45"]))) == [12, 30, 42, 1, 2, 45]
    assert one(spark, arrays.reconciled(o(["12", "11"], ["30", "31"], ["42"], ["1"], ["2"], ["45"]))) is None  # two ways
    assert one(spark, arrays.reconciled(o(["12"], ["x"], ["42"], ["1"], ["2"], ["45"]))) is None
    assert one(spark, arrays.reconciled(o(["42"], ["1"], ["2"], ["45"]))) is None  # too few columns


def test_reconciled_takes_many_readings(spark):
    """The product of the readings has 4 ** 14 entries; the sums are few."""
    r = __import__("random").Random(1)
    true = [r.randrange(10, 400) for _ in range(14)]
    options = [[str(t), str(t + 1000), "x", str(t)] for t in true] + [[str(sum(true))], ["3"], ["4"], [str(sum(true) + 7)]]
    assert arrays.only_way(options, 4, 5) == [*true, sum(true), 3, 4, sum(true) + 7]
    got = spark.createDataFrame([(options,), (None,), ([["1"]] * 5,)], "o array<array<string>>").select(arrays.reconciled(F.col("o")).alias("r")).collect()
    assert [x["r"] for x in got] == [[*true, sum(true), 3, 4, sum(true) + 7], None, None]


def test_halves_are_rounded_to_even(spark):
    none = F.lit(None).cast("string")
    h = one(spark, quality.health(F.lit(1000), F.lit(0), F.lit(0), F.lit(150), F.lit(False), none, F.lit(True)))
    assert (h["provenance"], h["total"]) == (2.2, 72)  # 2.25 and 72.2
    assert one(spark, numbers.change(F.lit(800), F.lit(801)))["delta_pct"] == 0.12  # 0.125


def test_repeated_rows_keep_their_anchors(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 5), ("a", 90)], "k string, at int")
    anchors = spark.createDataFrame([("a", 4, 1), ("a", 6, 2)], "k string, at int, x int")
    got = sequence.nearest(rows, anchors, ["k"], "at", "at", "x", 3).collect()
    assert sorted((r["at"], r["nearest"]) for r in got if r["nearest"]) == [(5, 1), (5, 1)] and len(got) == 3


def test_gaps_of_a_stray_number_are_ranges(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 2), ("a", 2_000_000_000), (None, 1), (None, 3), ("b", None)], "g string, n int")
    got = {r["g"]: ([tuple(x) for x in r["missing"]], r["n_missing"]) for r in quality.gaps(rows, ["g"], "n").collect()}
    assert got == {"a": ([(1, 1), (3, 1_999_999_999)], 1_999_999_998), None: ([(2, 2)], 1), "b": ([], 0)}
    got = quality.gaps(rows, ["g"], "n", upper=F.lit(4)).collect()
    assert {r["g"]: [tuple(x) for x in r["missing"]] for r in got} == {"a": [(1, 1), (3, 4)], None: [(2, 2), (4, 4)], "b": [(1, 4)]}


def test_medians_of_groups(spark):
    r = __import__("random").Random(2)
    rows = [(g, r.choice([None, r.randint(0, 10**6) / 8])) for g in ("a", "b", None) for _ in range({"a": 9001, "b": 2}.get(g, 500))]
    got = {x["g"]: x["m"] for x in results.medians(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], m=F.col("v")).collect()}
    for g in ("a", "b", None):
        own = [v for k, v in rows if k == g and v is not None]
        assert got.get(g) == (__import__("statistics").median(own) if own else None)


def test_shares_show_what_is_always_shown(spark):
    rows = spark.createDataFrame([(1, "A", 900), (1, "B", 95), (1, "C", 3), (1, "NOTA", 2), (1, None, 0)], "g int, name string, votes int")
    assert {r["name"]: r["votes"] for r in results.shares(rows, ["g"], "name", "votes").collect()} == {"A": 900, "B": 95, "Others": 3, "NOTA": 2}


def test_text(spark):
    t = lambda f, *a: one(spark, f(*[F.lit(x) for x in a]))
    assert t(text.place_found_in, "काला गांव", "प्राथमिक विद्यालय कालागाव") is True
    assert t(text.place_found_in, "", "x") is False
    assert t(text.building_matches, "राजकीय प्राथमिक विद्यालय", "राजकीय") is None
    assert t(text.room_number, "कक्ष क.न. २") == "2"
    assert t(text.gender, " female ") == "F" and t(text.gender, "पुरुष") == "M" and t(text.gender, "") == "UNKNOWN"
    assert one(spark, text.plausible_age(F.lit("17"))) is None and t(text.plausible_age, " 18 ") == 18
    assert t(text.id_format, "abc1234567") and t(text.id_format, "UP/1/423/0153455") and not t(text.id_format, "X1")
    assert t(text.first_int, "Part ४२, no 7") == 42
    assert t(text.slug, " A-b C!") == "a-b-c"
    assert t(text.base_name, "a\\b/c.pdf") == "c.pdf"
    assert t(text.null_if_blank, " NULL ") is None and t(text.null_if_blank, " x ") == "x"
    assert one(spark, text.label_number(F.lit("12-A"))).asDict() == {"number": 12, "suffix": "A"}
    assert one(spark, text.trimmed_readings(F.array(F.lit("123")))) == ["123", "23", "12"]
    assert t(text.text_overlap, "", "x") == 0.0
    assert t(text.name_key, "A b​C") == "abc"
    assert one(spark, search.numbered_query(F.lit("booth no. 10"))) == 10
    assert one(spark, coverage.note_fields(F.lit("stored a=1 b=x=y a=2"))) == {"a": "1", "b": "x=y"}


def test_decoder(spark):
    decode = text.decoder({"ab": "x", "a": "y"}, (("xy", "z"),))
    df = spark.createDataFrame([("aba",), ("b",), (None,)], "t string")
    assert [r[0] for r in df.select(decode("t")).collect()] == ["z", "b", None]
    assert [r[0] for r in spark.createDataFrame([("é",), (None,)], "t string").select(text.nfc("t")).collect()] == ["é", None]


def test_validation_and_duplicates(spark):
    rows = [(1, 1, 1, "A", "B", 30, "M", "FATHER", ""), (1, 2, 1, "C", "D", 17, "F", "OTHER", "bad"), (1, 3, None, " ", "D", None, None, None, None), (1, 4, 9, "a ", "b", 30, "M", "FATHER", "")]
    df = spark.createDataFrame(rows, "roll_id int, pos int, serial int, name string, relative_name string, age int, gender string, relative_type string, id_number string")
    got = {r["pos"]: r for r in quality.validated(df).collect()}
    assert got[1]["is_valid"] and got[1]["duplicate_kind"] is None
    assert got[2]["validation_notes"] == "age out of range; id format; duplicate serial 1" and got[2]["duplicate_kind"] == "exact"
    assert got[3]["validation_notes"] == "serial missing; name missing; gender unknown; relation unknown"
    assert got[4]["duplicate_kind"] == "fuzzy" and got[4]["duplicate_of"] == 1


@pytest.mark.parametrize(("numbers_", "want"), [([*range(1, 21), 500], [500]), ([*range(1, 9)], None), ([*range(1, 21), 500, 501, 700], [700]), ([*range(1, 21), 22, 23], None)])
def test_tail_outliers(spark, numbers_, want):
    df = spark.createDataFrame([(1, x) for x in numbers_], "g int, n long")
    got = quality.tail_outliers(df, ["g"], "n").collect()
    assert (got[0]["outliers"] if got else None) == want


def test_gaps(spark):
    df = spark.createDataFrame([(1, 2), (1, 5), (2, 0)], "g int, n long")
    got = {r["g"]: r["missing"] for r in quality.gaps(df, ["g"], "n").collect()}
    assert got == {1: [(1, 1), (3, 4)], 2: []}


def test_health_and_flags(spark):
    lit = F.lit
    h = one(spark, quality.health(lit(100), lit(1), lit(2), lit(50), lit(False), lit("review"), lit(False)))
    assert (h["validation"], h["confidence"], h["provenance"], h["mapping"], h["total"], h["band"]) == (18.0, 13.5, 7.5, 5.0, 64, "Partial")
    none = lit(None).cast("long")
    assert one(spark, quality.health(none, none, none, none, lit(True), lit("none"), lit(False)))["total"] == 15
    codes = [f["code"] for f in one(spark, quality.flags(none, none, none, none.cast("double"), lit(0), lit(0), lit("none"), lit("none")))]
    assert codes == ["NO_ELECTORATE", "NO_MAPPING", "HISTORICAL_MISSING"]


def test_decision(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    d = lambda t, p, b: one(spark, linkage.decision(F.lit(t).cast("long"), p, b))
    assert d(3, arr(3, 4), arr(3, 4))["part"] == 3
    assert d(9, arr(3), arr(3, 5))["part"] == 3
    got = d(9, arr(1, 2), arr(3))
    assert (got["status"], got["candidates"], got["reason"]) == ("review", [1, 2, 3], "place and building disagree")
    assert d(9, arr(1, 2, 3, 4, 5), arr())["candidates"] == []
    assert d(None, arr(1), arr(1))["status"] == "unmapped"


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "n", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None, "z"), (3, "c", None), (None, "m", None)], "k int, v string, w string")
    rows = lambda d: {r["k"]: (r["v"], r["w"]) for r in d.collect()}
    assert rows(store.upsert(old, new, ["k"])) == {1: (None, "z"), 2: ("b", None), 3: ("c", None), None: ("m", None)}
    merged = store.upsert_keep(old, new, ["k"])
    assert rows(merged) == {1: ("a", "z"), 2: ("b", None), 3: ("c", None), None: ("m", "y")}
    assert rows(store.upsert_keep(merged, new, ["k"])) == rows(merged)  # a second run changes nothing
    assert rows(store.replace_by_parent(old.na.drop(subset=["k"]), new.filter("k = 3"), spark.createDataFrame([(1,), (3,)], "k int"), ["k"])) == {2: ("b", None), 3: ("c", None)}


def test_sequence(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (1, 3, 20.0)], "g int, i int, v double")
    assert [r["cluster"] for r in sequence.gap_clusters(df, ["g"], F.col("v"), 2.0).orderBy("i").collect()] == [0, 0, 1]
    left, right = df.select("g", "i"), spark.createDataFrame([(1, 0, "a"), (1, 2, "b")], "g int, at int, x string")
    assert [r["x_asof"] for r in sequence.as_of(left, right, ["g"], "i", "at", ["x"]).orderBy("i").collect()] == ["a", "b", "b"]


def test_summary_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 1, [5, 5], 10), (2, 1, [9, 1], 10), (3, 1, [3, 1], 9), (4, 1, None, None)], "id int, sheet int, votes array<bigint>, total_valid long")
    r = results.summary(results.with_margin(results.checked(df, ["sheet"])), ["sheet"], "id").first()
    assert (r["n_rows"], r["verified"], r["review"], r["close"], r["narrowest"], r["widest"]) == (4, 2, 2, 1, 1, 2)
