"""Linkage over orders, customers, parts, documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.operators import linkage
from tallysheet.plans.registry import query, table


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS cust_id, o_custkey % 200 AS num, o_custkey % 25 AS nat FROM orders),
p AS (SELECT c_custkey AS pid, c_custkey % 200 AS num, c_nationkey % 25 AS nat FROM customer),
u AS (SELECT num, nat, CASE WHEN count(*) = 1 THEN min(pid) END AS linked_id FROM p GROUP BY ALL)
SELECT o_orderkey, p.pid AS linked_id FROM c LEFT JOIN p ON c.cust_id = p.pid WHERE cust_id IS NOT NULL
UNION ALL SELECT o_orderkey, u.linked_id FROM c LEFT JOIN u ON c.num = u.num AND c.nat = u.nat WHERE cust_id IS NULL""")
def dual_key_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to customers by id, or where that is unknown by a number in a nation, if unique."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_custkey")).alias("cust_id"), (F.col("o_custkey") % 200).alias("num"), (F.col("o_custkey") % 25).alias("nat"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 200).alias("num"), (F.col("c_nationkey") % 25).cast("long").alias("nat"))
    return linkage.by_id_or_number(o, c, "cust_id", "pid", ["num", "nat"]).select("o_orderkey", "linked_id")


@query("SELECT p_brand, p_size, CASE WHEN count(*) = 1 THEN min(p_partkey) END AS p_partkey FROM part GROUP BY ALL")
def unique_or_null_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.unique_or_null(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey")


@query("WITH m AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_quantity > 45) SELECT part, 'Mapped' AS status FROM m UNION ALL SELECT p_partkey, 'Not Mapped' FROM part WHERE p_partkey NOT IN (SELECT part FROM m)")
def anti_unmapped_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("part")).distinct().withColumn("status", F.lit("Mapped"))
    return linkage.add_unmapped(m, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")), ["part"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')))")
def semi_join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").filter(F.col("r_name").startswith("A"))
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


#: Words of three letters or more, so that blocks and scores agree in both engines.
WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(%s), '[^a-zà-öø-ÿñß]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"


def _word_set(c: str):
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.col(c)), "[^a-zà-öø-ÿñß]+", " ")), " "), lambda x: F.length(x) >= 3))


def _share_join(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    sets = lambda name, key: table(spark, sf_dir, name).select(key, _word_set("text").alias("words"))
    return linkage.word_share_join(sets("benchmark", "item_id"), sets("documents", "doc_id"), "item_id", "doc_id", least)


SHARED = f"""WITH b AS (SELECT item_id, unnest(ws) AS w, len(ws) AS n_words FROM (SELECT item_id, {WORDS % 'text'} AS ws FROM benchmark)),
d AS (SELECT doc_id, unnest({WORDS % 'text'}) AS w FROM documents),
n AS (SELECT item_id, doc_id, count(*) AS n, count(*)::DOUBLE / any_value(n_words) AS share FROM d JOIN b USING (w) GROUP BY item_id, doc_id)
"""


@query(SHARED + "SELECT item_id, doc_id, n FROM n WHERE share = 1")
def place_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have every word of a passage."""
    return _share_join(spark, sf_dir, 1.0).select("item_id", "doc_id", "n")


@query(SHARED + ", r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(share) OVER w, 0) AS second FROM n WINDOW w AS (PARTITION BY item_id ORDER BY share DESC, doc_id)) SELECT item_id, doc_id, round(share, 6) AS best FROM r WHERE k = 1 AND share >= 0.6 AND share - second >= 0.15")
def text_overlap_top1_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of a passage, if it has 0.6 of its words and leads by 0.15."""
    best = linkage.best_by_gap(_share_join(spark, sf_dir, 0.45), "item_id", "doc_id", 0.6, 0.15)
    return best.select("item_id", "doc_id", F.round("share", 6).alias("best"))


@query("""WITH l AS (SELECT l_partkey AS id, list_sort(list(DISTINCT l_suppkey % 8) FILTER (l_returnflag = 'A')) AS p, list_sort(list(DISTINCT l_suppkey % 8) FILTER (l_returnflag = 'R')) AS b FROM lineitem GROUP BY 1),
t AS (SELECT id, coalesce(p, []) AS p, coalesce(b, []) AS b, CASE WHEN id % 9 <> 0 THEN id % 8 END AS to_part FROM l),
i AS (SELECT *, list_sort(list_intersect(p, b)) AS bth FROM t),
d AS (SELECT id, CASE WHEN to_part IS NULL THEN 'unmapped' WHEN list_contains(bth, to_part) OR len(bth) = 1 THEN 'verified' ELSE 'review' END AS status,
CASE WHEN to_part IS NULL THEN NULL WHEN list_contains(bth, to_part) THEN to_part WHEN len(bth) = 1 THEN bth[1] END AS part,
CASE WHEN len(bth) > 0 THEN bth ELSE list_sort(list_distinct(list_concat(p, b))) END AS near,
CASE WHEN len(bth) > 1 THEN 'several stations match place and building' WHEN len(p) > 0 AND len(b) > 0 THEN 'place and building disagree' WHEN len(p) > 0 THEN 'place only' WHEN len(b) > 0 THEN 'building only' ELSE 'neither place nor building match' END AS reason FROM i)
SELECT id, status, part, CASE WHEN status = 'review' AND len(near) <= 4 THEN len(near) ELSE 0 END::INT AS n_candidates, CASE WHEN status = 'review' THEN reason END AS reason FROM d""")
def mapping_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mappings: suppliers modulo 8 of returned and accepted lines are the two kinds of evidence."""
    k = F.col("l_suppkey") % 8
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.collect_set(F.when(F.col("l_returnflag") == "A", k)).alias("p"), F.collect_set(F.when(F.col("l_returnflag") == "R", k)).alias("b"))
    d = li.select("id", linkage.decision(F.when(F.col("id") % 9 != 0, F.col("id") % 8), F.col("p"), F.col("b")).alias("d"))
    return d.select("id", "d.status", "d.part", F.size("d.candidates").alias("n_candidates"), "d.reason")


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def mapping_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return linkage.first_of_key(li, [F.col("l_partkey"), F.col("l_suppkey")], ["l_orderkey", "l_linenumber", "l_extendedprice"]).drop("l_extendedprice")


@query("""WITH col AS (SELECT o_custkey % 20 AS sheet, o_orderkey % 6 AS col, sum(o_orderkey % 11)::BIGINT AS a, count(*) AS b FROM orders GROUP BY ALL),
cand AS (SELECT o_custkey % 20 AS sheet, 'cand' || (o_orderkey % 6) AS name, sum(o_orderkey % 11)::BIGINT + CASE WHEN o_custkey % 20 < 5 AND o_orderkey % 6 = 2 THEN 1 ELSE 0 END AS a, count(*) AS b FROM orders GROUP BY o_custkey % 20, o_orderkey % 6),
j AS (SELECT col.sheet, col.col, count(name) AS n, min(name) AS name FROM col LEFT JOIN cand USING (sheet, a, b) GROUP BY ALL),
s AS (SELECT sheet, bool_and(n = 1) AND count(DISTINCT name) = count(*) AS ok FROM j GROUP BY sheet)
SELECT sheet, col, CASE WHEN ok THEN name END AS name FROM j JOIN s USING (sheet)""")
def column_names_by_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for columns with the same two totals; five sheets have one that differs and get no names."""
    o = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("sheet"), (F.col("o_orderkey") % 6).alias("col")).agg(F.sum(F.col("o_orderkey") % 11).alias("a"), F.count("*").alias("b"))
    cand = o.select("sheet", F.concat(F.lit("cand"), F.col("col")).alias("name"), (F.col("a") + F.when((F.col("sheet") < 5) & (F.col("col") == 2), 1).otherwise(0)).alias("a"), "b")
    return linkage.matching_totals(o, cand, ["sheet"], "col", ["a", "b"], "name")
