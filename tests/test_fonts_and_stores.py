"""Font repair on hand-worked words, landed responses, and sinks that overwrite, append and copy."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallysheet.functions import fonts, text
from tallysheet.operators import reports, store
from tallysheet.sources import html, records


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("typed", "want"), [("पुŜष", "पुरुष"), ("िनवाŊचक", "निर्वाचक"), ("िस्थित  NULL x", "स्थिति x"), ("NULLS", "NULLS"), ("", ""), (None, "")])
def test_repaired(spark, typed, want):
    assert one(spark, fonts.repaired(F.col("t"), {"Ŝ": "रु", "Ŋ": "र्"}, "[\\x{0300}-\\x{036f}]"), t=typed) == want


@pytest.mark.parametrize(("typed", "want"), [("पूव[", "पूर्व"), ("ͪवधान", "विधान"), ("ͪ èथान", "स्थिान"), ("ͪवɮयालय", "विɮयालय"), ("घालय", "द्यालय"), ("Ēाम", "ग्राम"), (None, None)])
def test_visual_order(spark, typed, want):
    assert one(spark, fonts.visual_repaired(F.col("t")), t=typed) == want


def test_glyph_tables_must_not_depend_on_order():
    with pytest.raises(ValueError):
        fonts.with_glyphs(F.lit("x"), {"a": "b", "b": "c"})


def test_converted(spark):
    decode = text.decoder({"d": "क", "k": "ा", "kk": "ॉ"})
    rows = [("कख 12",), ("12-3",), ("dk dq",), ("  ",), (None,), ("d" * 25 + " क",)]
    got = [r["c"] for r in spark.createDataFrame(rows, "t string").select(fonts.converted(F.col("t"), decode).alias("c")).collect()]
    assert [(c["text"], c["raw"], round(c["confidence"], 3)) for c in got] == [("कख 12", "कख 12", 1.0), ("12-3", "12-3", 1.0), ("का कq", "dk dq", 0.8), (None, None, 1.0), (None, None, 1.0), ("क" * 25 + " क", "d" * 25 + " क", 1.0)]


def test_legacy_font(spark):
    for t, want in (("a" * 19, False), ("a " * 20, True), ("a" * 11 + "1" * 9, True), ("a" * 10 + "1" * 10, False), ("a" * 15 + "क" * 5, False), ("a" * 16 + "क" * 4, True), (None, False)):
        assert one(spark, text.legacy_font(F.col("t")), t=t) is want


def test_responses(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text(json.dumps(rows))
        return str(tmp_path / name)

    d = records.districts(spark, put("d.json", [{"districtNo": "2", "districtCd": " B ", "districtValue": "y"}, {"districtNo": "x", "districtCd": "A"}]))
    assert [tuple(r) for r in d.collect()] == [(None, "A", None), (2, "B", "y")]
    c = records.constituencies(spark, put("c.json", [{"asmblyNo": "7", "asmblyName": " n ", "districtCd": "A"}]))
    assert [tuple(r)[:3] for r in c.collect()] == [(7, "n", "A")]
    p = records.parts(spark, put("p.json", [{"partNo": "12A", "partName": " q "}]))
    assert [tuple(r) for r in p.collect()] == [(12, "q")]
    body = spark.createDataFrame([('{"success": true, "data": [{"a": 1}, {"a": 2}]}',)], "body string")
    assert [r["a"] for r in records.enveloped(body, "body", "struct<a int>").collect()] == [1, 2]
    with pytest.raises(PySparkException):
        records.enveloped(spark.createDataFrame([('{"success": false}',)], "body string"), "body", "struct<a int>").collect()
    names = spark.createDataFrame([("North Hill",), ("hill",), ("Hilltop",)], "name string")
    assert [r["name"] for r in records.resolved(names, "name", " HILL ").collect()] == ["hill"]
    assert [r["name"] for r in records.resolved(names, "name", "top").collect()] == ["Hilltop"]
    assert records.resolved(names, "name", "zzz").count() == 0


def test_links(spark):
    urls = spark.createDataFrame([("/Form20_23/a.pdf",), ("/form20_18/a.pdf",), ("/a.pdf",)], "u string")
    assert [r["k"] for r in urls.select(html.of_year(F.col("u"), F.lit(2023)).alias("k")).collect()] == [True, False, True]
    found = spark.createDataFrame([("12 and 99", "x"), ("12 and 13", "y"), ("none", "z"), ("AC 12", "x")], "label string, href string")
    got = html.attributed(found, F.array(F.lit(12), F.lit(13))).collect()
    assert [(r["number"], r["href"]) for r in got] == [(12, "x")]


def test_anchored_rows(spark):
    words = spark.createDataFrame([("p", 1.0, 0.0, "head"), ("p", 0.0, 5.0, "1"), ("p", 3.0, 6.0, "a"), ("p", 0.0, 9.0, "2")], "page string, x0 double, y0 double, text string")
    got = records.rows_of_anchors(words, ["page"], F.col("text").rlike("^[0-9]+$")).collect()
    assert sorted((r["text"], r["anchor_y"]) for r in got) == [("1", 5.0), ("2", 9.0), ("a", 5.0)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = str(tmp_path / "parts")
    store.overwrite_partitions(rows, out, ["k"])
    store.overwrite_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), out, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]
    store.append_log(rows, str(tmp_path / "log"))
    store.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    wider = store.with_missing_columns(rows, {"v": "int", "w": "date"})
    assert wider.dtypes == [("k", "int"), ("v", "string"), ("w", "date")] and wider.filter("w is not null").count() == 0
    rows.write.parquet(str(tmp_path / "src/t.parquet"))
    copy = lambda **x: store.copy_tables(spark, ["t"], str(tmp_path / "src"), str(tmp_path / "dst"), **x)
    assert [tuple(r) for r in copy().collect()] == [("t", 2)]
    with pytest.raises(PySparkException):
        copy()
    assert [tuple(r) for r in copy(replace=True).collect()] == [("t", 2)]
    records.write_json(rows, str(tmp_path / "json"))
    assert spark.read.schema("k int, v string").json(str(tmp_path / "json")).count() == 2
    records.write_lines(spark.createDataFrame([("x",), (None,)], "l string"), "l", str(tmp_path / "lines"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["x"]


def test_reports_on_empty_tables(spark):
    none = spark.createDataFrame([], "sheet int, number int, votes array<int>, words int, confidence double")
    assert reports.serial_coverage(none, ["sheet"], "number").count() == 0
    assert reports.over_read(none, none, ["sheet"]).count() == 0
    nulls = spark.createDataFrame([(1, None, None, 0, 0.5)], none.schema)
    assert [tuple(r) for r in reports.serial_coverage(nulls, ["sheet"], "number").collect()] == [(1, 0, 0.0)]
    assert [tuple(r) for r in reports.mean_confidence(nulls, ["sheet"]).collect()] == [(1, 0.0)]
