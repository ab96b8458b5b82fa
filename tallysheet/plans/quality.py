"""Record quality over documents, orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallysheet.functions import text
from tallysheet.functions.numbers import rate
from tallysheet.operators import quality, sequence
from tallysheet.plans.registry import query, table


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS male, count(*) FILTER (o_orderstatus = 'O') AS female, count(*) FILTER (o_custkey % 3 > 0) AS with_id, count(*) FILTER (o_totalprice < 50000) AS invalid, count(*) FILTER (o_custkey % 7 = 0) AS duplicates, count(*) FILTER (o_totalprice < 50000 AND o_custkey % 7 <> 0) AS other_invalid, count(*) FILTER (o_custkey % 20 >= 1 AND (76 + 8 * (o_custkey % 20))::DOUBLE / 128 < 0.95) AS low_confidence, round(avg(CASE WHEN o_custkey % 20 >= 1 THEN (76 + 8 * (o_custkey % 20))::DOUBLE / 128 END), 6) AS mean_confidence, count(*) FILTER (o_custkey % 11 <> 0) AS provenance_complete FROM orders GROUP BY 1")
def record_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: status as gender, keys modulo small numbers as ids, duplicates, confidence and provenance."""
    k = F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select(
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", "M").when(F.col("o_orderstatus") == "O", "F").alias("gender"),
        F.when(k % 3 > 0, "x").otherwise("").alias("id_number"),
        (F.col("o_totalprice") >= 50000).alias("is_valid"),
        F.when(k % 7 == 0, "exact").alias("duplicate_kind"),
        F.when(k % 20 >= 1, (76 + 8 * (k % 20)) / 128).alias("confidence"),
        F.when(k % 11 != 0, "u").alias("source_url"),
    )
    out = quality.record_aggregates(r, ["o_orderpriority"], ["source_url"])
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("SELECT l_returnflag, sum(n)::BIGINT AS n, round(sum(q)::DOUBLE / sum(n), 6) AS mean_quantity FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL) GROUP BY 1")
def mergeable_aggregate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts of a finer grouping, merged; the mean is weighted."""
    fine = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return fine.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.sum("q").alias("q")).select("l_returnflag", "n", F.round(F.col("q") / F.col("n"), 6).alias("mean_quantity"))


@query("SELECT event_type, coalesce(round(100.0::DOUBLE * count(*) FILTER (value > 1000000000) / nullif(count(*) FILTER (value > 2000000000), 0), 6), 0.0) AS empty_rate, round(100.0::DOUBLE * count(*) FILTER (user_id % 2 = 0) / count(*), 6) AS even_rate FROM events GROUP BY 1")
def rates_zero_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 1e9).alias("a"), F.count_if(F.col("value") > 2e9).alias("b"), F.count_if(F.col("user_id") % 2 == 0).alias("even"), F.count("*").alias("n"))
    return e.select("event_type", F.round(rate(F.col("a"), F.col("b")), 6).alias("empty_rate"), F.round(rate(F.col("even"), F.col("n")), 6).alias("even_rate"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, dup_rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS dup_rank FROM lineitem) WHERE dup_rank > 1")
def duplicate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = quality.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"])
    return li.filter("dup_rank > 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "dup_rank")


@query(r"WITH k AS (SELECT doc_id, lang, md5(lower(regexp_replace(text, '[\s\x{200b}-\x{200d}\x{00a0}]+', '', 'g'))) AS key FROM documents), f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY key, lang ORDER BY doc_id) AS first_id FROM k) SELECT doc_id, first_id AS duplicate_of FROM f WHERE first_id <> doc_id")
def duplicate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal without white space and case, in one language: later ones point to the first. Keys are hashed, so texts aren't shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(text.name_key(F.col("text"))).alias("key"))
    d = d.withColumn("duplicate_of", F.first("doc_id").over(Window.partitionBy("key", "lang").orderBy("doc_id")))
    return d.filter("duplicate_of <> doc_id").select("doc_id", "duplicate_of")


@query("WITH k AS (SELECT doc_id, md5(text) AS key FROM documents) SELECT a.doc_id, min(b.doc_id) AS original_id FROM k a JOIN k b ON a.key = b.key AND b.doc_id < a.doc_id GROUP BY 1")
def duplicate_link_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy with the least id of its text. The originals are aggregated first, so a text of many copies makes no pairs."""
    k = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    o = k.groupBy("key").agg(F.min("doc_id").alias("original_id"))
    return k.join(o, "key").filter("doc_id <> original_id").select("doc_id", "original_id")


VALID = """WITH p AS (SELECT c_custkey AS id, c_nationkey AS roll, CASE WHEN c_custkey % 37 <> 0 THEN c_custkey // 2 END AS serial, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE c_mktsegment END AS name, (c_custkey % 130)::INT AS age FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY roll, serial ORDER BY id) AS k FROM p),
m AS (SELECT id, roll, list_filter([CASE WHEN serial IS NULL THEN 'serial missing' END, CASE WHEN trim(name) = '' THEN 'name missing' END, CASE WHEN age NOT BETWEEN 18 AND 120 THEN 'age out of range' END, CASE WHEN serial IS NOT NULL AND k > 1 THEN 'duplicate serial ' || serial END], lambda x: x IS NOT NULL) AS v FROM n)
SELECT id, roll, array_to_string(v, '; ') AS validation_notes, len(v) = 0 AS is_valid FROM m"""


@query(VALID)
def validation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("roll"), F.when(k % 37 != 0, F.floor(k / 2)).alias("serial"), F.when(k % 41 == 0, " ").otherwise(F.col("c_mktsegment")).alias("name"), (k % 130).cast("int").alias("age"),
        F.lit("").alias("relative_name"), F.lit("M").alias("gender"), F.lit("OTHER").alias("relative_type"), F.lit("").alias("id_number"),
    )
    return quality.validated(p, roll="roll", pos="id").select("id", "roll", "validation_notes", "is_valid")


@query("""WITH n AS (SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 500 = 3 AND l_linenumber = 7 THEN 2000000000 ELSE l_linenumber END::BIGINT AS n FROM lineitem),
h AS (SELECT l_orderkey, coalesce(lag(n) OVER (PARTITION BY l_orderkey ORDER BY n), 0) + 1 AS a, n - 1 AS b FROM n)
SELECT l_orderkey, list(a || '-' || b ORDER BY a) AS missing, sum(b - a + 1)::BIGINT AS n_missing FROM h WHERE a <= b GROUP BY 1""")
def serial_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing line numbers as ranges; some orders have a stray number far beyond the others."""
    number = F.when((F.col("l_orderkey") % 500 == 3) & (F.col("l_linenumber") == 7), 2_000_000_000).otherwise(F.col("l_linenumber"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", number.alias("n"))
    return quality.gaps(li, ["l_orderkey"], "n").filter("n_missing > 0").withColumn("missing", F.transform("missing", lambda r: F.concat(r["first"], F.lit("-"), r["last"])))


@query("""WITH o AS (SELECT o_custkey % 100 AS grp, CASE WHEN o_orderkey % 997 < 2 THEN o_orderkey + 100000000 * (o_orderkey % 997 + 1) ELSE o_orderkey // 100 END AS num FROM orders),
r AS (SELECT *, row_number() OVER w AS pos, num - lag(num) OVER w AS d, count(*) OVER (PARTITION BY grp) AS n FROM o WINDOW w AS (PARTITION BY grp ORDER BY num)),
t AS (SELECT *, min(CASE WHEN d > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY num DESC, pos DESC ROWS UNBOUNDED PRECEDING) AS run, n - pos + 1 AS tail FROM r),
c AS (SELECT grp, min(pos) AS f FROM t WHERE n >= 10 AND run = 1 AND d > 100 AND tail <= greatest(3, n // 100) GROUP BY grp)
SELECT t.grp, list_sort(list(num)) AS outliers FROM t JOIN c USING (grp) WHERE pos >= f GROUP BY 1""")
def tail_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("grp"), F.when(k % 997 < 2, k + 100000000 * (k % 997 + 1)).otherwise(F.floor(k / 100)).alias("num"))
    return quality.tail_outliers(o, ["grp"], "num")


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_linenumber - lag(l_linenumber) OVER w BETWEEN 1 AND 3, false) OR coalesce(lead(l_linenumber) OVER w - l_linenumber BETWEEN 1 AND 3, false) AS agrees FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber, l_suppkey)")
def neighbour_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_suppkey")
    return quality.neighbour_agreement(li, ["l_orderkey"], ["l_shipdate", "l_partkey", "l_linenumber", "l_suppkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "agrees")


@query("SELECT l_orderkey, l_linenumber, l_partkey, q, before_sum, coalesce(q = before_sum, false) AS is_total FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, (sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS before_sum FROM lineitem)")
def running_sum_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    return sequence.running_identity(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "q").select("l_orderkey", "l_linenumber", "l_partkey", "q", "before_sum", "is_total")


@query("""WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, (sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM g""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in clusters with a day's gap between."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return sequence.gap_clusters(e, ["user_id"], F.col("us"), 86_400_000_000, ["event_id"]).select("event_id", "user_id", "cluster")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def asof_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sequence.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, event_type FROM events), a AS (SELECT user_id, s AS at, event_id AS anchor FROM e WHERE event_type = 'signup'),
j AS (SELECT e.event_id, arg_min(anchor, (abs(e.s - a.at), anchor)) AS nearest, min(abs(e.s - a.at)) AS distance FROM e JOIN a ON e.user_id = a.user_id AND abs(e.s - a.at) <= 200000 WHERE e.event_type = 'error' GROUP BY 1)
SELECT e.event_id, e.user_id, j.nearest, j.distance FROM e LEFT JOIN j USING (event_id) WHERE e.event_type = 'error'
UNION ALL SELECT e.event_id, e.user_id, j.nearest, j.distance FROM e LEFT JOIN j USING (event_id) WHERE e.event_type = 'error' AND e.event_id % 3 = 0""")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, of which each third stands twice, with the user's nearest signup within 200,000 seconds."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("s"), "event_type")
    a = e.filter("event_type = 'signup'").select("user_id", F.col("s").alias("at"), F.col("event_id").alias("anchor"))
    rows = e.filter("event_type = 'error'").select("event_id", "user_id", "s")
    return sequence.nearest(rows.union(rows.filter("event_id % 3 = 0")), a, ["user_id"], "s", "at", "anchor", 200_000).select("event_id", "user_id", "nearest", "distance")


@query("WITH m AS (SELECT o_orderpriority, o_orderstatus, median(round(o_totalprice * 100)::BIGINT) AS m FROM orders GROUP BY ALL) SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders JOIN m USING (o_orderpriority, o_orderstatus) WHERE round(o_totalprice * 100)::BIGINT <= greatest(1.5 * m, m + 400)")
def median_outlier_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return sequence.median_cut(o, ["o_orderpriority", "o_orderstatus"], "cents", 1.5, 400).select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def keep_richest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    return sequence.richest(li, ["l_orderkey", "l_linenumber"], F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("""WITH k AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY 1), n AS (SELECT o_custkey % 10 AS grp, size, count(*) AS n FROM k GROUP BY ALL)
SELECT grp, CASE WHEN max(n) * 5 > sum(n) THEN arg_max(size, n * 1000 + size) END AS modal FROM n GROUP BY grp""")
def modal_size_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual number of orders of a customer, if over a fifth have it (ties: the larger)."""
    k = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    n = k.groupBy((F.col("o_custkey") % 10).alias("grp"), "size").agg(F.count("*").alias("n"))
    top = n.groupBy("grp").agg(F.max(F.struct("n", "size")).alias("m"), F.sum("n").alias("t"))
    return top.select("grp", F.when(F.col("m.n") * 5 > F.col("t"), F.col("m.size")).alias("modal"))


LABELLED = """WITH s AS (SELECT source, count(*) AS total, count(*) FILTER (quality = 0) AS invalid, count(*) FILTER (toxic = 1) AS low FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 0).alias("invalid"), F.count_if(F.col("toxic") == 1).alias("low"))


@query(LABELLED + ", n AS (SELECT *, CASE WHEN invalid > 3 THEN 'review' WHEN invalid > 1 THEN 'verified' END AS mapping FROM s), f AS (SELECT source, list_filter([CASE WHEN invalid > 0 THEN 'DATA_QUALITY' END, CASE WHEN low::DOUBLE / total > 0.05 THEN 'LOW_CONFIDENCE' END, CASE WHEN invalid = 0 AND low::DOUBLE / total <= 0.05 THEN 'CLEAN' END, CASE WHEN low > 2 THEN 'SERIAL_GAPS' END, CASE WHEN mapping = 'verified' THEN 'MAPPING_VERIFIED' WHEN mapping = 'review' THEN 'MAPPING_REVIEW' ELSE 'NO_MAPPING' END, 'HISTORICAL_MISSING'], lambda x: x IS NOT NULL) AS v FROM n) SELECT source, array_to_string(v, ' ') AS flags FROM f")
def booth_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents as stations: labels of low quality are invalid rows, toxic ones have low confidence."""
    s = _sources(spark, sf_dir)
    mapping = F.when(F.col("invalid") > 3, "review").when(F.col("invalid") > 1, "verified")
    flags = quality.flags(F.col("total"), F.col("invalid"), F.col("low"), F.lit(1.0), F.lit(0), F.when(F.col("low") > 2, 1).otherwise(0), mapping, F.lit("none"))
    return s.select("source", F.array_join(F.transform(flags, lambda x: x["code"]), " ").alias("flags"))


@query(LABELLED + ", h AS (SELECT source, 20.0::DOUBLE AS electorate, round_even(20 * greatest(0, 1 - 10 * invalid::DOUBLE / total), 1) AS validation, round_even(15 * greatest(0, 1 - 5 * low::DOUBLE / total), 1) AS confidence, round_even(15 * (total - low)::DOUBLE / total, 1) AS provenance, CASE WHEN invalid > 3 THEN 5.0 ELSE 0.0 END::DOUBLE AS mapping FROM s), t AS (SELECT *, round_even(electorate + validation + confidence + provenance + mapping, 0)::INT AS total FROM h) SELECT source, validation, confidence, provenance, mapping, total, CASE WHEN total >= 75 THEN 'Strong' WHEN total >= 50 THEN 'Partial' ELSE 'Limited' END AS band FROM t")
def booth_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    h = quality.health(F.col("total"), F.col("invalid"), F.col("low"), F.col("total") - F.col("low"), F.lit(False), F.when(F.col("invalid") > 3, "review"), F.lit(False))
    return s.select("source", h.alias("h")).select("source", "h.validation", "h.confidence", "h.provenance", "h.mapping", "h.total", "h.band")


@query(LABELLED + ", a AS (SELECT source, 'invalid' AS what, 'bad' AS level, invalid AS n FROM s WHERE invalid > 0 UNION ALL SELECT source, 'low confidence', CASE WHEN low::DOUBLE / total > 0.05 THEN 'warn' ELSE 'info' END, low FROM s WHERE low > 0 UNION ALL SELECT source, 'clean', 'good', 0 FROM s WHERE invalid = 0 AND low = 0) SELECT list_position(['bad', 'warn', 'info', 'good'], level)::BIGINT - 1 AS level_rank, source, what, level, n FROM a")
def alerts_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts by level, then source and kind: a range-partitioned sort, no task sees all."""
    s = _sources(spark, sf_dir)
    alert = lambda rows, what, level, n: rows.select("source", F.lit(what).alias("what"), level.alias("level"), n.alias("n"))
    a = alert(s.filter("invalid > 0"), "invalid", F.lit("bad"), F.col("invalid"))
    a = a.unionByName(alert(s.filter("low > 0"), "low confidence", F.when(F.col("low") / F.col("total") > quality.LOW_SHARE, "warn").otherwise("info"), F.col("low")))
    a = a.unionByName(alert(s.filter("invalid = 0 and low = 0"), "clean", F.lit("good"), F.lit(0).cast("long")))
    return a.select(quality.level_rank(F.col("level")).alias("level_rank"), "source", "what", "level", "n").orderBy("level_rank", "source", "what")


@query("""WITH t AS (SELECT l_suppkey % 40 AS sheet, count(*) AS n, count(*) FILTER (l_discount < 0.095 OR l_suppkey % 40 < 30) AS passed, count(DISTINCT l_linenumber) * (l_suppkey % 40) * 20 AS dist, 1000 + 25 * (l_suppkey % 40) AS expected FROM lineitem GROUP BY l_suppkey % 40)
SELECT sheet, n, CASE WHEN n < 10 THEN 'too few rows' WHEN passed::DOUBLE / n < 0.9 THEN 'sum checks fail' WHEN n::DOUBLE / expected < 0.9 THEN 'rows missing' WHEN dist::DOUBLE / n < 0.75 THEN 'repeated numbers' END AS reason FROM t""")
def sheet_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey") % 40
    t = table(spark, sf_dir, "lineitem").groupBy(k.alias("sheet")).agg(F.count("*").alias("n"), F.count_if((F.col("l_discount") < 0.095) | (k < 30)).alias("passed"), F.countDistinct("l_linenumber").alias("d"))
    return t.select("sheet", "n", quality.gate(F.col("n"), F.col("passed"), 1000 + 25 * F.col("sheet"), F.col("d") * F.col("sheet") * 20).alias("reason"))
