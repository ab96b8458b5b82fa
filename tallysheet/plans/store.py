"""Writes as functions of old and new state, sets, sorts, pages and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.operators import search, store
from tallysheet.plans.registry import query, table


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Old rows, and new ones for a third of the keys (a seventh of those without a segment) and for keys beyond."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    new = c.filter(k % 3 == 0).select(F.when(k % 5 == 0, k + 10_000_000).otherwise(k).alias("c_custkey"), F.when(k % 7 != 0, F.concat(F.lit("NEW "), "c_mktsegment")).alias("c_mktsegment"), F.col("c_nationkey"))
    return c, new


NEW = """WITH n AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS k, CASE WHEN c_custkey % 7 <> 0 THEN 'NEW ' || c_mktsegment END AS s, c_nationkey AS t FROM customer WHERE c_custkey % 3 = 0)
"""


@query(NEW + "SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(s, c_mktsegment) AS c_mktsegment, coalesce(t, c_nationkey) AS c_nationkey FROM customer FULL JOIN n ON c_custkey = k")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_keep(*_customers(spark, sf_dir), ["c_custkey"])


@query(NEW + "SELECT coalesce(k, c_custkey) AS c_custkey, CASE WHEN k IS NOT NULL THEN s ELSE c_mktsegment END AS c_mktsegment, CASE WHEN k IS NOT NULL THEN t ELSE c_nationkey END AS c_nationkey FROM customer FULL JOIN n ON c_custkey = k")
def upsert_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_customers(spark, sf_dir), ["c_custkey"])


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey >= 5 UNION ALL SELECT s_suppkey + 100000, s_nationkey FROM supplier WHERE s_nationkey < 4")
def replace_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations 0 to 4 are replaced; the fifth has no new rows and ends empty."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    new = s.filter("s_nationkey < 4").withColumn("s_suppkey", F.col("s_suppkey") + 100_000)
    return store.replace_by_parent(s, new, s.filter("s_nationkey < 5").select("s_nationkey"), ["s_nationkey"])


@query("SELECT (n_nationkey + (SELECT max(n_nationkey) FROM nation))::BIGINT AS id, n_name, CASE WHEN n_nationkey % 4 > 0 THEN (n_regionkey + (SELECT max(r_regionkey) FROM region))::BIGINT END AS region_id FROM nation")
def id_shift_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.select(F.col("n_nationkey").cast("long").alias("id"), "n_name", F.when(F.col("n_nationkey") % 4 > 0, F.col("n_regionkey").cast("long")).alias("region_id"))
    return store.shifted(rows, store.max_id(rows), {"region_id": store.max_id(r, "r_regionkey")})


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT * FROM o))
SELECT 'nation' AS table_name, count(*) AS n_rows FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def export_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "lineitem")}
    cut = store.scoped(t, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")], "nation", t["nation"].filter("n_regionkey = 1"))
    out = None
    for name, rows in cut.items():
        n = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("""WITH p AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS cents, 'x' || o_orderkey AS v FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT -1, 5, 'y'),
s AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS cents FROM orders)
SELECT coalesce(s.o_orderkey, p.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NULL THEN 'missing' WHEN p.o_orderkey IS NULL THEN NULL WHEN s.cents = p.cents THEN 'updated' ELSE 'mismatched' END AS backfill, CASE WHEN s.cents = p.cents THEN p.v END AS note FROM s FULL JOIN p ON s.o_orderkey = p.o_orderkey""")
def backfill_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    p = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("cents") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("cents"), F.concat(F.lit("x"), "o_orderkey").alias("note"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(5).cast("long").alias("cents"), F.lit("y").alias("note"))
    return store.backfill(o.withColumn("note", F.lit(None).cast("string")), p.unionByName(extra), ["o_orderkey"], "cents", ["note"]).select("o_orderkey", "backfill", "note")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 10 FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey") + 10)).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey + 10 FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 10).alias("k")))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey + 10 FROM supplier")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return a.subtract(table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 10).alias("k")))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def page_offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 3, 25).select("c_custkey", "c_name")


@query("SELECT count(*) AS n_rows, ceil(count(*) / 25.0)::BIGINT AS n_pages FROM customer")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pages(table(spark, sf_dir, "customer"), 25)


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY nullif(o_orderstatus, 'P') ASC NULLS LAST, o_orderpriority DESC, o_orderkey LIMIT 100")
def multi_key_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.orderBy(F.nullif("o_orderstatus", F.lit("P")).asc_nulls_last(), F.desc("o_orderpriority"), "o_orderkey").limit(100)


SEARCH = """WITH h AS (SELECT 0 AS kind_no, 'region' AS kind, r_name AS label, 1 AS hit_rank FROM region WHERE r_name ILIKE '%an%'
UNION ALL SELECT 1, 'nation', n_name, CASE WHEN n_regionkey = 2 THEN 0 ELSE 1 END FROM nation WHERE n_name ILIKE '%an%'
UNION ALL SELECT 2, 'part', p_name || ' #' || p_partkey, 1 FROM part WHERE p_name ILIKE '%an%' OR p_type ILIKE '%an%')
SELECT kind, label, hit_rank, kind_no FROM h ORDER BY hit_rank, kind_no, label LIMIT 60"""


@query(SEARCH)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = "an"
    r = search.hits(table(spark, sf_dir, "region"), "region", q, ["r_name"], None, F.col("r_name"))
    n = search.hits(table(spark, sf_dir, "nation"), "nation", q, ["n_name"], "n_nationkey", F.col("n_name"), F.col("n_regionkey") == 2)
    p = search.hits(table(spark, sf_dir, "part"), "part", q, ["p_name", "p_type"], "p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey")))
    return search.top([r, n, p])


@query("SELECT l_orderkey, '[' || array_to_string(list(l_linenumber ORDER BY l_linenumber, l_partkey), ',') || ']' AS numbers, count(*)::INT AS n FROM lineitem GROUP BY 1")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array to JSON and back; the array that comes back is counted."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    j = a.select("l_orderkey", F.to_json(F.transform("a", lambda x: x["l_linenumber"])).alias("numbers"))
    return j.withColumn("n", F.size(F.from_json("numbers", "array<int>")))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 'au') GROUP BY 1")
def client_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table filter of a page: a substring of several columns together."""
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    return c.filter(search.matches(["c_name", "c_mktsegment"], "au")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
