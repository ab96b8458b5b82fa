"""Overviews over orders, customers, parts and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import parties
from tallysheet.operators import overview
from tallysheet.plans.registry import query, table

#: Mapping rows: a line's part is the old one, its supplier the new one; discounts say how sure it is.
MAPS = """WITH m AS (SELECT l_partkey % 25 AS ac, l_partkey AS part, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_suppkey % 9 > 0 THEN l_suppkey % 6 END AS to_part,
CASE WHEN l_discount < 0.025 THEN 'verified' WHEN l_discount < 0.055 THEN 'review' WHEN l_discount < 0.075 THEN 'unmapped' WHEN l_discount < 0.085 THEN 'odd' END AS status,
CASE WHEN l_discount < 0.025 THEN l_suppkey % 6 END AS linked_station, l_returnflag AS area FROM lineitem)
"""


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    status = F.when(d < 0.025, "verified").when(d < 0.055, "review").when(d < 0.075, "unmapped").when(d < 0.085, "odd")
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 25).alias("ac"), F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey") % 6).alias("to_part"), status.alias("status"), F.when(d < 0.025, F.col("l_suppkey") % 6).alias("linked_station"), F.col("l_returnflag").alias("area"))


LABEL = "CASE WHEN status = 'verified' THEN 'Verified' WHEN status = 'unmapped' THEN 'Not Mapped' ELSE 'Review Required' END"
COUNTS = f"count(*) FILTER ({LABEL} = 'Verified') AS verified, count(*) FILTER ({LABEL} = 'Review Required') AS review_required, count(*) FILTER ({LABEL} = 'Not Mapped') AS not_mapped"


@query(MAPS + f"SELECT ac, {COUNTS} FROM m GROUP BY 1")
def mapping_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.status_counts(mappings(spark, sf_dir), ["ac"])


@query(MAPS + f"SELECT {COUNTS} FROM m")
def mapping_status_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.summed(overview.status_counts(mappings(spark, sf_dir), ["ac"]), ["verified", "review_required", "not_mapped"])


@query(MAPS + f"""SELECT part, count(*) AS rows, coalesce(list_sort(list(DISTINCT to_part) FILTER (to_part IS NOT NULL)), []) AS targets, count(*) FILTER ({LABEL} = 'Verified') AS verified, count(*) FILTER ({LABEL} = 'Review Required') AS review,
count(DISTINCT to_part) > 1 AS split, count(DISTINCT linked_station)::INT AS n_stations, count(linked_station)::INT AS n_villages FROM m GROUP BY 1""")
def edition_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = overview.changes(mappings(spark, sf_dir), ["part"])
    villages = F.aggregate("stations", F.lit(0), lambda a, x: a + F.size(x["villages"]))
    return c.select("part", "rows", "targets", "verified", "review", "split", F.size("stations").alias("n_stations"), villages.alias("n_villages"))


@query(MAPS + f", g AS (SELECT ac, part, count(*) AS n, count(DISTINCT to_part) AS k, count(*) FILTER ({LABEL} = 'Verified') AS v, count(*) FILTER ({LABEL} = 'Review Required') AS r FROM m GROUP BY ALL) SELECT ac, count(*) AS parts, count(*) FILTER (k > 1) AS split_parts, sum(n)::BIGINT AS mapping_rows, sum(v)::BIGINT AS verified, sum(r)::BIGINT AS review FROM g GROUP BY 1")
def edition_change_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.change_totals(overview.changes(mappings(spark, sf_dir), ["ac", "part"]), ["ac"])


@query(MAPS + "SELECT part, count(*) AS rows, count(*) FILTER (status = 'verified') AS verified, CASE WHEN count(*) FILTER (status = 'verified') > 0 THEN 'verified' WHEN count(*) FILTER (status = 'review') > 0 THEN 'review' ELSE 'none' END AS mapping_status FROM m GROUP BY 1")
def station_mapping_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.station_status(mappings(spark, sf_dir), ["part"])


@query("SELECT c_custkey, CASE WHEN count(o_orderkey) FILTER (o_orderstatus = 'P') > 0 THEN 'unlinked' ELSE 'none' END AS historical FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def historical_link_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", overview.historical_status(F.col("n")).alias("historical"))


@query(MAPS + f""", s AS (SELECT c_nationkey::BIGINT AS ac, c_custkey, 'e' || c_custkey % 3 AS edition FROM customer), r AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1),
a AS (SELECT ac, count(*) AS stations, count(total) AS with_roll, coalesce(sum(total), 0)::BIGINT AS records, list_sort(list(DISTINCT edition)) AS editions FROM s LEFT JOIN r ON c_custkey = o_custkey GROUP BY 1),
k AS (SELECT ac, {COUNTS} FROM m GROUP BY 1)
SELECT a.*, coalesce(verified, 0) AS verified, coalesce(review_required, 0) AS review_required, coalesce(not_mapped, 0) AS not_mapped, round(100.0::DOUBLE * with_roll / stations, 6) AS coverage_pct FROM a LEFT JOIN k USING (ac)""")
def constituency_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stations of their nation, orders as records."""
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("ac"), F.col("c_custkey").alias("station"), F.concat(F.lit("e"), F.col("c_custkey") % 3).alias("edition"))
    r = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("station")).agg(F.count("*").alias("total"))
    return overview.constituency_overview(s, r, mappings(spark, sf_dir), "ac", "station").withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("WITH n AS (SELECT o_orderpriority, o_custkey % 97 AS k, count(*) AS n FROM orders WHERE o_custkey % 97 <> 5 GROUP BY ALL) SELECT o_orderpriority, arg_min(k, (-n, k)) AS k, max(n) AS n FROM n GROUP BY 1")
def most_frequent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.when(F.col("o_custkey") % 97 != 5, F.col("o_custkey") % 97).alias("k"))
    return overview.most_frequent(o, ["o_orderpriority"], "k")


@query("""WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_suppkey, l_linenumber AS serial, CASE WHEN l_quantity > 5 THEN l_quantity < 45 END AS is_valid, CASE WHEN l_tax > 0.075 THEN 'exact' END AS kind,
l_orderkey * 10 + 1 AS dup, l_discount * 10 AS conf FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))
SELECT s.s_nationkey::BIGINT AS ac_number, e.l_suppkey AS part, p.p_size AS year, e.id, e.serial, CASE WHEN e.kind IS NOT NULL THEN 'duplicate' WHEN NOT coalesce(e.is_valid, false) THEN 'validation' ELSE 'low_confidence' END AS issue, d.serial AS duplicate_serial, round(e.conf, 4) AS confidence
FROM e JOIN part p ON p.p_partkey = e.l_partkey JOIN supplier s ON s.s_suppkey = e.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey LEFT JOIN e d ON d.id = e.dup WHERE e.is_valid = false OR e.conf < 0.95""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records: invalid ones and those of a small discount, with part, supplier and nation as roll, station and constituency."""
    from tallysheet.operators.sequence import richest

    li = richest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"))
    q = F.col("l_quantity")
    e = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("roll_id"), F.col("l_suppkey").alias("station_id"), F.col("l_linenumber").alias("serial"), F.when(q > 5, q < 45).alias("is_valid"), F.when(F.col("l_tax") > 0.075, "exact").alias("duplicate_kind"), (F.col("l_orderkey") * 10 + 1).alias("duplicate_of_id"), (F.col("l_discount") * 10).alias("confidence"))
    rolls = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("roll_id"), F.col("p_size").alias("year"))
    stations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_id"), F.col("s_nationkey").alias("ac_id"), F.col("s_suppkey").alias("part"))
    acs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ac_id"), F.col("n_nationkey").cast("long").alias("ac_number"))
    return overview.review_rows(e, rolls, stations, acs)


@query("WITH n AS (SELECT o_custkey % 20 AS g, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT g, string_agg(n || ' ' || s, ', ' ORDER BY n DESC, s) AS line FROM n GROUP BY 1")
def run_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("g"), "o_orderstatus")
    return overview.outcome_lines(o, ["g"], "o_orderstatus")


@query("WITH t AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 7 < 2 OR c_mktsegment = 'BUILDING' GROUP BY ALL) SELECT c_nationkey, sum(n)::BIGINT AS total, max(n) AS top, max(n) >= sum(n)::BIGINT // 2 + 1 AS has_majority FROM t GROUP BY 1")
def majority_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_custkey % 7 < 2 or c_mktsegment = 'BUILDING'")
    return overview.majority(overview.outcomes(c, ["c_nationkey"], "c_mktsegment"), ["c_nationkey"], "n")


@query("WITH l AS (SELECT l_suppkey, list_sort(list(DISTINCT l_partkey)) AS p FROM lineitem GROUP BY 1) SELECT l_suppkey, p[1:10] AS first, greatest(len(p) - 10, 0)::INT AS more FROM l")
def first_and_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("p"))
    return li.select("l_suppkey", overview.preview(F.col("p")).alias("x")).select("l_suppkey", "x.*")


@query("SELECT s_suppkey, 0 AS at, 'balance' AS label, CASE WHEN s_acctbal > 0 THEN 'good' ELSE 'bad' END AS state, s_nationkey::VARCHAR AS detail FROM supplier UNION ALL SELECT s_suppkey, 1, 'name', 'good', s_name FROM supplier")
def availability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return overview.unpivoted(s, ["s_suppkey"], {"balance": (F.when(F.col("s_acctbal") > 0, "good").otherwise("bad"), F.col("s_nationkey")), "name": (F.lit("good"), F.col("s_name"))})


PARTY = "(CASE o_orderpriority WHEN '1-URGENT' THEN ' trs' WHEN '2-HIGH' THEN 'BRS' WHEN '3-MEDIUM' THEN 'BHRS ' WHEN '4-NOT SPECIFIED' THEN 'NOTA' END)"


@query(f"""WITH o AS (SELECT o_custkey % 300 AS seat, o_orderdate, o_orderkey, {PARTY} AS party FROM orders), b AS (SELECT *, lag(party) OVER (PARTITION BY seat ORDER BY o_orderkey) AS previous FROM o WHERE party <> 'NOTA')
SELECT o_orderkey, previous, CASE WHEN previous IS NOT NULL THEN CASE WHEN upper(trim(previous)) = upper(trim(party)) OR (upper(trim(previous)) = 'TRS' AND upper(trim(party)) IN ('BRS', 'BHRS')) OR (upper(trim(party)) = 'TRS' AND upper(trim(previous)) IN ('BRS', 'BHRS')) THEN 'hold' ELSE 'gain' END END AS outcome FROM b""")
def seat_held_or_gained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as parties under an old and two later names; none of the above and nulls aren't candidates."""
    p = F.col("o_orderpriority")
    party = F.when(p == "1-URGENT", " trs").when(p == "2-HIGH", "BRS").when(p == "3-MEDIUM", "BHRS ").when(p == "4-NOT SPECIFIED", "NOTA")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 300).alias("seat"), party.alias("party")).filter(parties.contests(F.col("party")))
    return overview.held_or_gained(o, ["seat"], "o_orderkey", "party").select("o_orderkey", "previous", "outcome")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 25)::INT END AS id, (o_custkey % 5)::INT AS num, o_orderstatus AS state FROM orders), a AS (SELECT n_nationkey AS id, n_nationkey % 5 AS num, CASE WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS state FROM nation)
SELECT o_orderkey, a.id AS linked_ac FROM r JOIN a ON r.id = a.id OR (r.id IS NULL AND r.num = a.num AND r.state = a.state)""")
def results_by_id_or_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    r = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, (k % 25).cast("int")).alias("id"), (k % 5).cast("int").alias("num"), F.col("o_orderstatus").alias("state"))
    n = F.col("n_nationkey")
    a = table(spark, sf_dir, "nation").select(n.alias("id"), (n % 5).alias("num"), F.when(n % 2 == 0, "F").otherwise("O").alias("state"))
    return overview.results_of(a, r, "id", "num", "state").select("o_orderkey", "linked_ac")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END, 7) = 7 AS mine, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END::BIGINT AS rank, NOT starts_with(c_mktsegment, 'B') OR starts_with(c_mktsegment, 'BUI') AS in_state FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer GROUP BY c_nationkey, c_mktsegment)")
def scopes_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first customer of each nation and segment: whether it is in the scope of nation 7 (the default), its segment's rank, and whether the segment is shared or one's own."""
    c = table(spark, sf_dir, "customer").withColumn("state", F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")))
    one = overview.one_by_number(c, ["c_nationkey", "c_mktsegment"], "c_custkey").select("c_custkey")
    c = c.join(one, "c_custkey", "left_semi")
    return c.select("c_custkey", (overview.scoped(F.col("state"), 7) == 7).alias("mine"), overview.registry_rank(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).alias("rank"), overview.source_in_state(F.col("c_mktsegment"), "B", ["BUI"]).alias("in_state"))


@query("SELECT c_nationkey, list_sort(list(k)) AS numbers, sum(n)::BIGINT AS n_names FROM (SELECT c_nationkey, c_custkey % 6 AS k, min(CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 2 END) AS n FROM customer GROUP BY ALL) GROUP BY 1")
def names_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each number of a nation. The first in order of the lists is the shorter one, as the second name is empty for every fourth customer and the first alike."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 6).alias("k"), F.lit("a").alias("a"), F.when(F.col("c_custkey") % 4 != 0, "b").otherwise("").alias("b"))
    m = overview.names_by_number(c, ["c_nationkey"], "k", ["a", "b"])
    return m.select("c_nationkey", F.array_sort(F.map_keys("names")).alias("numbers"), F.aggregate(F.map_values("names"), F.lit(0).cast("bigint"), lambda s, x: s + F.size(x)).alias("n_names"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, o_custkey % 50 + 1)")
def station_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("now"), (F.col("o_custkey") % 50 + 1).alias("old"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_id"), "c_name")
    return overview.lineage(o, c, "now", "old").select("o_orderkey", "c_name")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1")
def cache_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.stamp(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("""WITH c AS (SELECT l_orderkey % 500 AS doc, l_orderkey AS n, CASE WHEN l_orderkey % 500 < 100 OR (l_orderkey % 500 < 200 AND l_linenumber % 2 = 0) THEN NULL ELSE l_quantity::BIGINT END AS cnt FROM lineitem WHERE l_linenumber < 6),
g AS (SELECT doc, count(*) AS n, count(*)::DOUBLE / (max(n) - min(n) + 1) AS cov, count(cnt) AS counted FROM c GROUP BY 1)
SELECT doc, n, counted, CASE WHEN n < 10 OR cov < 0.0004 OR NOT (counted >= 0.9 * n OR counted <= 0.05 * n) THEN 'refused' WHEN counted <= 0.05 * n THEN 'without counts' ELSE 'whole' END AS verdict FROM g""")
def district_list_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as station lists; some have no counts, some in half of their rows."""
    from tallysheet.operators.layout import list_gate

    doc = F.col("l_orderkey") % 500
    none = (doc < 100) | ((doc < 200) & (F.col("l_linenumber") % 2 == 0))
    c = table(spark, sf_dir, "lineitem").filter("l_linenumber < 6").select(doc.alias("doc"), F.col("l_orderkey").alias("n"), F.when(~none, F.col("l_quantity").cast("long")).alias("cnt"))
    return list_gate(c, ["doc"], "n", "cnt", coverage=0.0004).select("doc", "n", "counted", "verdict")


@query("""WITH c AS (SELECT l_partkey, CASE WHEN l_linenumber > 3 THEN l_quantity::BIGINT END AS v, l_discount AS conf, l_shipdate::DATE::VARCHAR AS area, l_orderkey FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (v IS NULL)::INT, conf DESC, length(area) DESC, v NULLS LAST, area) AS k, min(v) OVER (PARTITION BY l_partkey) AS lo, max(v) OVER (PARTITION BY l_partkey) AS hi FROM c)
SELECT l_partkey, conf, area, CASE WHEN lo = hi THEN v END AS v FROM k WHERE k = 1""")
def copies_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallysheet.operators.layout import merged_copies

    c = table(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_linenumber") > 3, F.col("l_quantity").cast("long")).alias("v"), F.col("l_discount").alias("conf"), F.to_date("l_shipdate").cast("string").alias("area"))
    return merged_copies(c, ["l_partkey"], "v", "conf", "area").select("l_partkey", "conf", "area", "v")


@query("""WITH l AS (SELECT (c_custkey % 30) AS sheet, c_custkey, CASE WHEN c_custkey % 11 = 0 THEN (c_custkey // 30) || 'A' WHEN c_custkey % 13 = 0 THEN 'x' ELSE (c_custkey // 30)::VARCHAR END AS label FROM customer)
SELECT sheet, coalesce(max(nullif(regexp_extract(label, '^(\\d+)\\s*([A-Z]*)$', 1), '')::INT), 0) + count(DISTINCT label) FILTER (regexp_extract(label, '^(\\d+)\\s*([A-Z]*)$', 2) <> '') AS expected FROM l GROUP BY 1""")
def expected_booths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallysheet.operators.layout import expected_booths as expected

    k, n = F.col("c_custkey"), F.floor(F.col("c_custkey") / 30).cast("string")
    c = table(spark, sf_dir, "customer").select((k % 30).alias("sheet"), F.when(k % 11 == 0, F.concat(n, F.lit("A"))).when(k % 13 == 0, "x").otherwise(n).alias("label"))
    return expected(c, ["sheet"])


@query("""WITH r AS (SELECT o_custkey AS block, o_orderkey % 50 AS general, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 3 END AS postal, o_orderkey % 50 + o_orderkey % 3 + CASE WHEN o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS total FROM orders),
b AS (SELECT c_custkey AS block, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS printed_total FROM customer),
g AS (SELECT block, count(*) AS n, bool_or(general + postal <> total) AS wrong, sum(total)::BIGINT AS s FROM r GROUP BY 1)
SELECT block, coalesce(n, 0) AS n, coalesce(s, 0) AS sum_total, CASE WHEN coalesce(wrong, false) THEN 'row_mismatch' WHEN printed_total <> coalesce(s, 0) THEN 'total_mismatch' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status FROM b LEFT JOIN g USING (block)""")
def report_block_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as blocks; those without orders are empty."""
    from tallysheet.sources.workbooks import block_check

    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("block"), (k % 50).alias("general"), F.when(k % 7 > 0, k % 3).alias("postal"), (k % 50 + k % 3 + F.when(k % 41 == 0, 1).otherwise(0)).alias("total"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("block"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("printed_total"))
    return block_check(r, ["block"], b).select("block", "n", "sum_total", "status")


@query("SELECT p_brand, round(sum(length(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) - length(regexp_replace(regexp_replace(p_name, '[^A-Za-z]', '', 'g'), '(?i)[aeiou]', '', 'g')))::DOUBLE / greatest(sum(length(regexp_replace(p_name, '[^A-Za-z]', '', 'g'))), 1), 6) AS vowel_share FROM part GROUP BY 1")
def vowel_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallysheet.sources import workbooks

    return workbooks.vowel_share(table(spark, sf_dir, "part"), ["p_brand"], "p_name").withColumn("vowel_share", F.round("vowel_share", 6))
