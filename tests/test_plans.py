"""Every query against its SQL on the smallest tables, and the sources, sinks and streams."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tallysheet import plans
from tallysheet.sources import html, records
from tallysheet.streaming import events

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@needs_data
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    want = duck.sql(plans.SQL[name])
    at = {c: i for i, c in enumerate(want.columns)}
    assert sorted(at) == cols
    assert got == sorted(repr([plain(r[at[c]]) for c in cols]) for r in want.fetchall())


def test_html(spark):
    page = """<html><title> T </title><script>const DATA = {"a": [1, 2]};</script><input type="hidden" name="k" value="v"><select><option value="0">pick</option><option value="7"> x <b>y</b></option></select>
    <table><tr><th>n</th><td>1 <i>2</i></td></tr></table><a href="p.pdf">12 - Name</a><a href='q.pdf'>12 again</a><a href="javascript:Page$3">3</a></html>"""
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    r = {x["page_id"]: x for x in df.select("page_id", html.title(F.col("html")).alias("t"), html.hidden_fields(F.col("html")).alias("h"), html.options(F.col("html")).alias("o"), html.pager_numbers(F.col("html")).alias("p"), html.embedded_json(F.col("html"), "DATA", "a array<int>").alias("j")).collect()}
    assert (r[1]["t"], r[1]["h"], r[1]["p"], r[1]["j"]["a"]) == ("T", {"k": "v"}, [3], [1, 2])
    assert [(x["value"], x["label"]) for x in r[1]["o"]] == [("7", "x y")]
    assert r[2]["t"] is None
    assert [x["cells"] for x in html.table_rows(df).collect()] == [["n", "1 2"]]
    from tallysheet.functions.text import leading_int

    assert [(x["number"], x["href"]) for x in html.first_by_number(html.anchors(df), "page_id", leading_int(F.col("label"))).orderBy("number").collect()] == [(3, "javascript:Page$3"), (12, "p.pdf")]


def test_records(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"stateId": "5", "stateCd": " S05 ", "stateName": "X"}, {"stateId": "6"}]')
    assert [tuple(r) for r in records.states(spark, str(tmp_path / "s.json")).collect()] == [(5, "S05", "X", None)]
    words = spark.createDataFrame([("d", 5.0, 1.0, "b"), ("d", 1.0, 2.0, "a"), ("d", 1.0, 9.0, "c")], "page string, x0 double, y0 double, text string")
    assert [r["line_text"] for r in records.reading_lines(words, ["page"]).orderBy("line").collect()] == ["a b", "c"]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    assert records.files(spark, str(tmp_path / "a.pdf")).first()["kind"] == "pdf"
    records.write_review(spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part*.csv")).read_bytes()
    assert body == "﻿k,v\n1,a\n".encode()


@needs_data
def test_streams(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    table.coalesce(1).write.parquet(str(tmp_path / "in/x"))
    stream = events.read_events(spark, str(tmp_path / "in/x"))
    q = events.keep_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(r["user_id"], r["event_type"]): r["event_id"] for r in spark.read.parquet(str(tmp_path / "ledger/0")).collect()}
    want = {(r["user_id"], r["event_type"]): r["event_id"] for r in plans.QUERIES["ledger_latest_wins"](spark, SF).collect()}
    assert got == want
    q = events.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == table.count()
