"""The evaluation of mappings on hand-worked rows and against pairs compared one by one, and late rows and sessions of a stream."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallysheet.functions import text
from tallysheet.operators import linkage
from tallysheet.streaming import events


def test_evaluated(spark):
    m = spark.createDataFrame(
        [(1, 10, 5, "Alpha", 1, "Alpha town hall"), (2, 10, 5, "alpha", 1, "Alpha town hall"), (3, 11, 5, "Beta", 2, "Beta mill house"), (4, 12, 5, "Gamma", None, "x"), (5, 13, 5, "Delta", 9, "quite unlike anything"), (6, 14, 6, "Alpha", 1, "Alpha town hall")],
        "id int, from_part int, ac_number int, area string, to_part int, building string",
    )
    s = spark.createDataFrame(
        [(5, 1, "Alpha town hall", "Alpha town hall", "Alpha"), (5, 2, "Omega old school", "Omega old school", "Beta west"), (5, 3, "Beta mill house north", "Beta mill house north", "Omega")],
        "ac_number int, part_number int, text string, name string, areas string",
    )
    rows = spark.createDataFrame([(5, 2, "east", "Beta mill house north", "Omega")], "ac_number int, serial int, locality string, building string, areas string")
    got = {r["id"]: r for r in linkage.evaluated(m, s, rows).collect()}
    assert sorted(got) == [1, 3, 4, 5, 6]
    assert (got[1]["status"], got[1]["part"], got[1]["suggestions"], got[1]["same_number"]) == ("verified", 1, [], True)
    assert (got[3]["status"], got[3]["part"], got[3]["suggestions"], got[3]["reason"]) == ("review", None, [3], "place and building disagree")
    assert (got[4]["status"], got[4]["same_number"]) == ("unmapped", False)
    assert (got[5]["status"], got[5]["suggestions"], got[5]["same_number"]) == ("review", [], False)
    assert (got[6]["status"], got[6]["reason"]) == ("review", "neither place nor building match")


def pairs_decided(m, s, most):
    """Each mapping with each station of its constituency."""
    pairs = m.join(s, "ac_number", "left")
    place = F.when(text.place_found_in(F.col("area"), F.coalesce("areas", "text")), F.col("part_number"))
    building = F.when(F.coalesce(text.building_matches(F.col("building"), F.col("text")), F.lit(False)) | F.coalesce(text.building_phrase_in(F.col("building"), F.col("name")), F.lit(False)), F.col("part_number"))
    hits = pairs.groupBy("id", "ac_number", "area", "to_part", "building").agg(F.collect_set(place).alias("p"), F.collect_set(building).alias("b"))
    return hits.select("id", "ac_number", "to_part", linkage.decision(F.col("to_part"), F.col("p"), F.col("b"), most).alias("decision"))


def pairs_bridged(review, rows, stations, least_building, least, gap):
    r = rows.select("ac_number", F.col("serial").alias("to_part"), F.concat_ws(" ", "locality", "building").alias("_row"), F.col("building").alias("_building"), F.col("areas").alias("_areas"))
    near = review.join(r, ["ac_number", "to_part"]).filter(text.text_overlap(F.col("building"), F.col("_row")) >= least_building)
    only = near.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).filter("_n = 1")
    a, b = text.room_number(F.col("_building")), text.room_number(F.col("name"))
    scored = only.join(stations, "ac_number").filter(a.isNull() | b.isNull() | (a == b))
    score = 0.5 * text.text_overlap(F.col("_building"), F.col("name")) + 0.5 * text.text_overlap(F.col("_areas"), F.col("areas"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), F.desc("part_number"))
    ranked = scored.withColumn("score", score).withColumn("_rank", F.row_number().over(w)).withColumn("_next", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.filter((F.col("_rank") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("_next") >= gap)).select("id", F.col("part_number").alias("suggested_part"), "score")


def phrase(r, most=3, words=("alpha", "beta", "gamma", "mill house", "town hall", "Omega-3", "(old)", "क.न. 2", "क.न. 3", "राजकीय", "")):
    return None if r.random() < 0.06 else " ".join(r.choice(words) for _ in range(r.randint(0, most)))


@pytest.mark.parametrize("most", [1, 4])
def test_decisions_are_those_of_all_pairs(spark, most):
    """Texts that many rows share, nulls, brackets, repeated parts with other texts, parts without number, repeated ids and empty constituencies."""
    r = random.Random(most)
    some = lambda n, share=0.08: None if r.random() < share else r.randrange(n)
    m = spark.createDataFrame([(r.randrange(150), some(5), phrase(r), some(12, 0.2), phrase(r)) for _ in range(200)], "id int, ac_number int, area string, to_part int, building string").repartition(3)
    s = spark.createDataFrame([(some(4), some(12), phrase(r), phrase(r), phrase(r)) for _ in range(60)], "ac_number int, part_number int, text string, name string, areas string").repartition(3)
    got = sorted(map(repr, linkage.place_decisions(m, s, most=most).collect()))
    assert got == sorted(map(repr, pairs_decided(m, s, most).collect()))
    assert len({x.split("reason=")[1] for x in got}) == 6


@pytest.mark.parametrize("limits", [(0.5, 0.6, 0.15), (0.0, 0.3, 0.5), (0.4, 0.2, 0.0)])
def test_bridge_is_that_of_all_pairs(spark, limits):
    r = random.Random(7)
    some = lambda n, share=0.08: None if r.random() < share else r.randrange(n)
    v = spark.createDataFrame([(r.randrange(250), some(12), some(6), phrase(r)) for _ in range(300)], "id int, ac_number int, to_part int, building string").repartition(3)
    rows = spark.createDataFrame([(some(12), some(6), phrase(r), phrase(r), phrase(r, 2)) for _ in range(80)], "ac_number int, serial int, locality string, building string, areas string")
    s = spark.createDataFrame([(some(12), i % 70, phrase(r, 7), phrase(r, 7)) for i in range(90)], "ac_number int, part_number int, name string, areas string")
    got = sorted(map(repr, linkage.bridge(v, rows, s, *limits).collect()))
    assert got == sorted(map(repr, pairs_bridged(v, rows, s, *limits).collect()))
    assert got


def test_rows_of_equal_texts_are_compared_once(spark):
    """One constituency of 6000 mappings and 2000 stations with few texts; as pairs they took minutes."""
    m = spark.range(6000).selectExpr("cast(id as int) id", "5 ac_number", "concat('place', id % 4) area", "cast(id % 2000 as int) to_part", "concat('mill house ', elt(1 + id % 3, 'north', 'south', 'west')) building")
    s = spark.range(2000).selectExpr("5 ac_number", "cast(id as int) part_number", "concat('place', id % 4, ' mill house ', elt(1 + id % 3, 'north', 'south', 'west')) text")
    s = s.select("*", F.col("text").alias("name"), F.col("text").alias("areas"))
    began = time.time()
    got = linkage.place_decisions(m, s).select("decision.*").groupBy("status", "reason").count().collect()
    # Digits aren't compared, so a place points to all stations; the building points to a third of them.
    assert {tuple(r) for r in got} == {("verified", None, 2000), ("review", "several stations match place and building", 4000)}
    v = m.selectExpr("id", "ac_number", "to_part % 7 to_part", "building")
    rows = s.selectExpr("ac_number", "part_number % 7 serial", "'' locality", "name building", "areas")
    assert linkage.bridge(v, rows, s).count() == 0
    assert time.time() - began < 60


def test_late_rows_and_sessions(spark, tmp_path):
    """A row that comes after the watermark has passed its window isn't counted; one within the allowed lateness is."""

    def put(name, *rows):
        df = spark.createDataFrame([(i, t, 1, "a", 1.0, "{}") for i, t in rows], "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = events.read_events(spark, str(tmp_path / "in" / "*"))
        q = events.windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    put("a", (1, "2024-01-01 23:30:00"), (2, "2024-01-02 00:30:00"))
    run()
    put("b", (3, "2024-01-01 23:45:00"), (4, "2024-01-04 12:00:00"))
    run()
    put("c", (5, "2024-01-01 12:00:00"), (6, "2024-01-09 12:00:00"))
    run()
    put("d", (7, "2024-01-20 12:00:00"))
    run()
    got = {str(r["start"])[:10]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 1, "2024-01-04": 1, "2024-01-09": 1}
    table = spark.read.parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.col("ts").cast("timestamp"))
    s = events.sessions(table, "1 hour 1 second").orderBy("start").collect()
    assert [r["n"] for r in s] == [1, 3, 1, 1, 1]
