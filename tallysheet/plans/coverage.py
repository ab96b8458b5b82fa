"""Coverage, reports and the ledger, over customers, suppliers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.operators import coverage
from tallysheet.plans.registry import query, table


@query("""SELECT n_nationkey AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers, coalesce(o.n, 0) AS orders, coalesce(o.years, []) AS years FROM nation
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey
LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey
LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, list_sort(list(DISTINCT year(o_orderdate)::INT)) AS years FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o ON o.k = n_nationkey""")
def availability_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year")).join(c.select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey"))
    yearly = o.groupBy("nation", "year").agg(F.count("*").alias("n"))
    by = lambda t, k: t.groupBy(F.col(k).alias("nation")).agg(F.count("*").alias("n"))
    return coverage.availability(n, "nation", {"customers": by(c, "c_nationkey"), "suppliers": by(table(spark, sf_dir, "supplier"), "s_nationkey"), "orders": yearly}, {"years": yearly})


@query("SELECT n_regionkey AS region, count(*) AS units, coalesce(sum(n), 0)::BIGINT AS customers, bool_or(coalesce(rich, false)) AS has_rich FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, bool_or(c_acctbal > 9900) AS rich FROM customer GROUP BY 1) ON k = n_nationkey GROUP BY 1")
def district_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.bool_or(F.col("c_acctbal") > 9900).alias("rich"))
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumnRenamed("n_regionkey", "region")
    return coverage.rollup(n, ["region"], ["customers"], {"has_rich": F.col("rich")})


@query("SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS yr FROM orders")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("yr")).distinct()


@query("SELECT c_nationkey, count(*) AS without_orders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1")
def hierarchy_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return coverage.missing_children(c, o, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("without_orders"))


@query("SELECT o_orderkey, expected, found FROM (SELECT o_orderkey, (1 + o_orderkey % 6)::BIGINT AS expected, coalesce(n, 0) AS found FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey) WHERE expected <> found")
def children_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 6).alias("expected"))
    return coverage.count_mismatch(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "expected")


@query("""SELECT * FROM (VALUES ('regions', (SELECT count(*) FROM region)), ('nations', (SELECT count(*) FROM nation)), ('customers', (SELECT count(*) FROM customer)), ('suppliers', (SELECT count(*) FROM supplier)), ('parts', (SELECT count(*) FROM part)), ('orders', (SELECT count(*) FROM orders)), ('lines', (SELECT count(*) FROM lineitem)), ('events', (SELECT count(*) FROM events)), ('documents', (SELECT count(*) FROM documents)), ('labelled', (SELECT count(*) FROM labels)), ('pages', (SELECT count(*) FROM pages)), ('passages', (SELECT count(*) FROM benchmark)),
('orders_without_lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))), ('customers_with_orders', (SELECT count(DISTINCT o_custkey) FROM orders)), ('errors', (SELECT count(*) FROM events WHERE event_type = 'error')), ('users', (SELECT count(DISTINCT user_id) FROM events)), ('toxic', (SELECT count(*) FROM labels WHERE toxic = 1)), ('good', (SELECT count(*) FROM labels WHERE quality = 1)), ('turns', (SELECT count(*) FROM conversations))) AS t(metric, value)""")
def quality_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "benchmark", "conversations")}
    n = lambda d: d.agg(F.count("*").alias("n"))
    without = t["orders"].select("o_orderkey").join(t["lineitem"].select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return coverage.report(
        {
            "regions": n(t["region"]), "nations": n(t["nation"]), "customers": n(t["customer"]), "suppliers": n(t["supplier"]), "parts": n(t["part"]), "orders": n(t["orders"]), "lines": n(t["lineitem"]), "events": n(t["events"]), "documents": n(t["documents"]), "labelled": n(t["labels"]), "pages": n(t["pages"]), "passages": n(t["benchmark"]),
            "orders_without_lines": n(without), "customers_with_orders": t["orders"].agg(F.countDistinct("o_custkey").alias("n")), "errors": n(t["events"].filter("event_type = 'error'")), "users": t["events"].agg(F.countDistinct("user_id").alias("n")), "toxic": n(t["labels"].filter("toxic = 1")), "good": n(t["labels"].filter("quality = 1")), "turns": n(t["conversations"]),
        }
    )


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, bool_or(value > 90) AS ever_ok FROM events GROUP BY ALL")
def ledger_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each user and type; ever_ok is sticky."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 90)
    return coverage.latest_state(e, ["user_id", "event_type"], ["ts", "event_id"], "event_id", "value")


@query("SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 90 AND event_id % 2 = 0)")
def ledger_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys still to be done: those without a good entry of the current version."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 90).withColumn("version", F.when(F.col("event_id") % 2 == 0, "v2").otherwise("v1"))
    return coverage.pending(e.select("user_id", "event_type").distinct(), e, ["user_id", "event_type"], "v2")


@query("SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, 'form20' AS parser, (event_id % 7)::BIGINT AS ac FROM events WHERE event_type = 'signup'")
def note_field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a JSON column and of a note of key=value words."""
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    note = coverage.note_fields(F.concat(F.lit("stored parser=form20 ac="), F.col("event_id") % 7, F.lit(" ac=99 end")))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.try_element_at(note, F.lit("parser")).alias("parser"), F.try_element_at(note, F.lit("ac")).cast("long").alias("ac"))


@query("""WITH s AS (SELECT 0 AS stage_no, 'customers without orders' AS stage, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS items, 'customers' AS what
UNION ALL SELECT 1, 'orders without lines', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)), 'orders'
UNION ALL SELECT 2, 'documents without labels', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), 'documents'
UNION ALL SELECT 3, 'nations without region', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)), 'nations')
SELECT stage_no, stage, items, items > 0 AS needed, CASE WHEN items > 0 THEN items || ' ' || what ELSE 'complete' END AS reason FROM s""")
def plan_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lacks = lambda a, ka, b, kb: t(a).select(ka).join(t(b).select(F.col(kb).alias("_k")), F.col(ka) == F.col("_k"), "left_anti")
    return coverage.plan(
        [
            ("customers without orders", lacks("customer", "c_custkey", "orders", "o_custkey"), "customers"),
            ("orders without lines", lacks("orders", "o_orderkey", "lineitem", "l_orderkey"), "orders"),
            ("documents without labels", lacks("documents", "doc_id", "labels", "doc_id"), "documents"),
            ("nations without region", lacks("nation", "n_regionkey", "region", "r_regionkey"), "nations"),
        ]
    )


@query("SELECT 'text' AS column_name, count(text) AS present FROM documents UNION ALL SELECT 'lang', count(lang) FROM documents UNION ALL SELECT 'source', count(source) FROM documents UNION ALL SELECT 'n_chars', count(n_chars) FROM documents")
def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.provenance(table(spark, sf_dir, "documents"), ["text", "lang", "source", "n_chars"])


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed counts of a stream."""
    from tallysheet.streaming.events import windowed_counts

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e).select(F.col("start").cast("date").alias("day"), "event_type", "n")
