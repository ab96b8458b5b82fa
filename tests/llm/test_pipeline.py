"""The pipeline's stages against what they are to do with rows planted for them, on nulls, empty tables, and their SQL-less results."""

import random

import pytest

import corpus_pipeline as pipeline
from tallysheet.llm import pii


def say(r, n):
    return " ".join("".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    from tallysheet.session import ship

    ship(spark)
    r = random.Random(20)
    passage = " ".join(say(r, 12) + "." for _ in range(6))
    rows = [(i, " ".join(say(r, 12) + "." for _ in range(8)), "en", "s", 0) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 0), (51, rows[4][1].replace(" ", "  "), "en", "s", 0), (52, rows[5][1] + " one more", "en", "s", 0)]
    rows += [(60 + i, f"{say(r, 30)} {passage} {say(r, 30)}", "en", "s", 0) for i in range(4)]
    rows += [(70, "12 34 56", "en", "s", 0), (71, "", "en", "s", 0), (72, None, "en", "s", 0), (73, say(r, 60) + " call +1 988 555 2485", "en", "s", 0)]
    return rows, passage, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_stages_do_what_they_say(spark, planted):
    rows, passage, d = planted
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        d = spark.createDataFrame(out.collect(), d.schema)
        kept[name] = {x["doc_id"]: x["text"] for x in d.collect()}
    clean = set(range(40)) | {60, 61, 62, 63, 73}
    assert set(kept["language ID"]) == clean | {50, 51, 52}
    assert set(kept["n-gram Jaccard join"]) == clean
    text = {x[0]: x[1] for x in rows}
    after = kept["substring dedup"]
    assert set(after) == clean and all(after[i] == text[i] for i in (*range(40), 60, 73))
    assert all(len(after[i].split()) < 60 + 20 and passage[20:-20] not in after[i] for i in (61, 62, 63))
    assert kept["PII"][73] != text[73] and "988 555 2485" not in kept["PII"][73] and all(kept["PII"][i] == after[i] for i in clean - {73})
    packed = pipeline.STAGES[-1][1](spark, d, "").collect()
    assert {x["doc_id"] for x in packed} == clean and all(x["offset"] + x["length"] <= 2048 for x in packed)


def test_empty(spark, planted):
    d = planted[2].limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.count() == 0
    assert pipeline.STAGES[-1][1](spark, d, "").count() == 0


def test_run_is_all_stages(spark, tmp_path, planted):
    planted[2].write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set(pii.KEY_SETTING, "k")
    got = pipeline.run(spark, str(tmp_path)).collect()
    d = planted[2]
    for _, stage in pipeline.STAGES:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), stage(spark, d, str(tmp_path)).schema)
    assert sorted(map(tuple, got)) == sorted(map(tuple, d.collect()))
    spark.conf.unset(pii.KEY_SETTING)
