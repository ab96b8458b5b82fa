"""Result rows made of lineitem: a row is a supplier's month, its columns the quantities by return flag, its sheet the year.

The printed total counts lines with a discount under 10 % only, so that some rows fail; suppliers whose key is 7 modulo 50 have no columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import arrays
from tallysheet.functions.numbers import change
from tallysheet.operators import results
from tallysheet.plans.registry import query, table


def vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_discount")
    by = ["supp", "yr", "mo"]
    f = li.groupBy(F.col("l_suppkey").alias("supp"), F.year("l_shipdate").alias("yr"), F.month("l_shipdate").alias("mo"), F.col("l_returnflag").alias("flag")).agg(F.sum("l_quantity").cast("long").alias("v"), F.sum(F.when(F.col("l_discount") < 0.10, F.col("l_quantity")).otherwise(0.0)).cast("long").alias("p"))
    r = f.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("flag", "v"))).alias("fv"), F.sum("p").alias("total_valid"))
    votes = F.when(F.col("supp") % 50 != 7, F.transform("fv", lambda x: x["v"]))
    return r.select(*by, (F.col("supp") * 10000 + (F.col("yr") - 1990) * 100 + F.col("mo")).alias("row_id"), votes.alias("votes"), F.transform("fv", lambda x: x["flag"]).alias("names"), "total_valid")


def checked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.with_margin(results.checked(vote_rows(spark, sf_dir), ["yr"]))


ROWS = """
WITH f AS (SELECT l_suppkey AS supp, year(l_shipdate)::INT AS yr, month(l_shipdate)::INT AS mo, l_returnflag AS flag,
                  sum(l_quantity)::BIGINT AS v, sum(CASE WHEN l_discount < 0.10 THEN l_quantity ELSE 0 END)::BIGINT AS p
           FROM lineitem GROUP BY ALL),
r AS (SELECT supp, yr, mo, (supp * 10000 + (yr - 1990) * 100 + mo)::BIGINT AS row_id,
             CASE WHEN supp % 50 <> 7 THEN list(v ORDER BY flag) END AS votes, list(flag ORDER BY flag) AS names, sum(p)::BIGINT AS total_valid
      FROM f GROUP BY supp, yr, mo),
m AS (SELECT yr, CASE WHEN max(n) * 2 > sum(n) THEN arg_max(k, n) END AS expected_columns
      FROM (SELECT yr, len(votes) AS k, count(*) AS n FROM r WHERE votes IS NOT NULL GROUP BY ALL) GROUP BY yr),
c AS (SELECT r.*, m.expected_columns,
             CASE WHEN votes IS NULL THEN 'not_backfilled'
                  WHEN list_sum(votes) <> total_valid OR (expected_columns IS NOT NULL AND len(votes) <> expected_columns) THEN 'check_failed'
                  ELSE 'ok' END AS status
      FROM r LEFT JOIN m USING (yr)),
s AS (SELECT *, list_reverse_sort(votes) AS d FROM c),
g AS (SELECT *, CASE WHEN status = 'ok' AND len(votes) >= 2 THEN d[1] - d[2] END AS margin,
             CASE WHEN status = 'ok' AND len(votes) >= 2 AND total_valid <> 0 THEN (d[1] - d[2])::DOUBLE * 100 / total_valid END AS margin_pct,
             CASE WHEN status = 'ok' AND len(votes) >= 2 AND total_valid <> 0 THEN d[1]::DOUBLE * 100 / total_valid END AS leader_share
      FROM s)
"""


@query(ROWS + "SELECT row_id, yr, mo, total_valid, expected_columns::INT AS expected_columns, status FROM c")
def row_check_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.checked(vote_rows(spark, sf_dir), ["yr"]).select("row_id", "yr", "mo", "total_valid", "expected_columns", "status")


@query(ROWS + "SELECT row_id, d[1]::BIGINT AS leader, d[2]::BIGINT AS runner_up, margin::BIGINT AS margin, round(margin_pct, 6) AS margin_pct, round(leader_share, 6) AS leader_share, len(list_filter(votes, lambda x: x > 0))::INT AS columns_with_votes FROM g WHERE margin IS NOT NULL")
def margin_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = checked_rows(spark, sf_dir).filter("margin is not null").select("row_id", "margin.*")
    return r.withColumns({c: F.round(c, 6) for c in ("margin_pct", "leader_share")})


@query(ROWS + "SELECT row_id, CASE WHEN d[1] > coalesce(d[2], -1) THEN names[list_position(votes, d[1])] END AS leader_name, CASE WHEN len(d) >= 2 AND d[2] < d[1] AND d[2] > coalesce(d[3], -1) THEN names[list_position(votes, d[2])] END AS runner_up_name FROM s WHERE votes IS NOT NULL")
def leader_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are withheld at ties."""
    r = vote_rows(spark, sf_dir).filter("votes is not null")
    return r.select("row_id", arrays.ranked_name(F.col("names"), F.col("votes"), 0).alias("leader_name"), arrays.ranked_name(F.col("names"), F.col("votes"), 1).alias("runner_up_name"))


@query(ROWS + """SELECT yr, count(*) AS n_rows, sum(total_valid)::BIGINT AS valid_votes, count(*) FILTER (status = 'ok') AS verified, count(*) FILTER (status <> 'ok') AS review,
round(median(margin), 6)::DOUBLE AS median_margin, round(median(margin_pct), 6) AS median_margin_pct, count(*) FILTER (margin_pct < 5) AS close,
arg_min(row_id, margin * 100000000 + row_id) FILTER (margin IS NOT NULL) AS narrowest, arg_max(row_id, margin * 100000000 - row_id) FILTER (margin IS NOT NULL) AS widest FROM g GROUP BY yr""")
def result_summary_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: checks, margins and a summary of each sheet, with two shuffles of partly aggregated rows."""
    out = results.summary(checked_rows(spark, sf_dir), ["yr"], "row_id")
    return out.withColumns({"median_margin": F.round("median_margin", 6), "median_margin_pct": F.round("median_margin_pct", 6)})


HIST = """, b AS (SELECT unnest(range(0, 6))::INT AS bin, unnest([0, 5, 10, 20, 30, 50]) AS lo, unnest([5, 10, 20, 30, 50, 101]) AS hi)
SELECT y.yr, b.bin, count(g.row_id) AS n FROM (SELECT DISTINCT yr FROM g) y CROSS JOIN b LEFT JOIN g ON g.yr = y.yr AND g.margin_pct >= b.lo AND g.margin_pct < b.hi GROUP BY ALL"""


@query(ROWS + HIST)
def margin_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.histogram(checked_rows(spark, sf_dir), ["yr"], F.col("margin.margin_pct"))


@query(ROWS + "SELECT yr, count(*) FILTER (status = 'ok') AS verified, count(*) FILTER (status = 'check_failed') AS check_failed, count(*) FILTER (status = 'not_backfilled') AS not_backfilled, count(*) FILTER (margin = 0) AS zero_margin, list_slice(list(row_id ORDER BY row_id) FILTER (status = 'check_failed'), 1, 10) AS first_review FROM g GROUP BY yr")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status and the ten first rows for review."""
    s = F.col("status")
    ranked = checked_rows(spark, sf_dir)
    ids = F.array_sort(F.collect_list(F.when(s == "check_failed", F.col("row_id"))))
    return ranked.groupBy("yr").agg(F.count_if(s == "ok").alias("verified"), F.count_if(s == "check_failed").alias("check_failed"), F.count_if(s == "not_backfilled").alias("not_backfilled"), F.count_if(F.col("margin.margin") == 0).alias("zero_margin"), F.slice(ids, 1, 10).alias("first_review"))


@query("""WITH l AS (SELECT l_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, count(*) AS n FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS id, o_custkey % 100 AS grp, l.n AS general, (l.cents % 7) AS postal, CASE WHEN o_orderkey % 400 = 3 THEN l.n ELSE l.n + l.cents % 7 END AS total, CASE WHEN o_orderkey % 90 = 1 THEN l.n END AS printed FROM orders JOIN l ON o_orderkey = l_orderkey)
SELECT grp, sum(total)::BIGINT AS sum_total, arg_min(printed, id) FILTER (printed IS NOT NULL) AS printed_total,
CASE WHEN bool_or(general + postal <> total) THEN 'row_mismatch' WHEN arg_min(printed, id) FILTER (printed IS NOT NULL) <> sum(total) THEN 'total_mismatch' ELSE 'ok' END AS status FROM x GROUP BY grp""")
def group_total_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are orders (lines, and their cents modulo 7, as the two parts); groups are customer keys modulo 100."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.count("*").alias("general"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    o = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("grp"), "general", (F.col("cents") % 7).alias("postal"))
    o = o.withColumn("total", F.when(F.col("id") % 400 == 3, F.col("general")).otherwise(F.col("general") + F.col("postal"))).withColumn("printed", F.when(F.col("id") % 90 == 1, F.col("general")))
    return results.group_check(o, ["grp"], ["general", "postal"], "total", "printed", "id")


def segment_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes: orders of each market segment by nation and year. id orders segments by name."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    v = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.year("o_orderdate").alias("yr"), "c_mktsegment").agg(F.count("*").alias("votes"))
    return v.withColumn("id", F.ascii("c_mktsegment"))


VOTES = """WITH v AS (SELECT c_nationkey, year(o_orderdate)::INT AS yr, c_mktsegment, count(*) AS votes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, yr ORDER BY votes DESC, ascii(c_mktsegment)) AS k FROM v),
win AS (SELECT c_nationkey, yr, max(c_mktsegment) FILTER (k = 1) AS winner, max(c_mktsegment) FILTER (k = 2) AS runner_up, max(votes) FILTER (k = 1) AS winner_votes, max(votes) FILTER (k = 1) - max(votes) FILTER (k = 2) AS margin, sum(votes)::BIGINT AS total_votes FROM w GROUP BY ALL)
"""


def seat_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.winners(segment_votes(spark, sf_dir), ["c_nationkey", "yr"], "votes", "id", "c_mktsegment")


@query(VOTES + "SELECT c_nationkey, yr, winner, runner_up, winner_votes, margin, round(margin * 100.0::DOUBLE / total_votes, 6) AS margin_pct, total_votes FROM win")
def winner_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seat_winners(spark, sf_dir).withColumn("margin_pct", F.round("margin_pct", 6))


@query(VOTES + "SELECT yr, coalesce(winner, '—') AS party, count(*) AS seats FROM win GROUP BY ALL")
def seat_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.tally(seat_winners(spark, sf_dir), ["yr"])


@query(VOTES + "SELECT c_nationkey, max(winner) FILTER (yr = 1994) AS y1994, max(winner) FILTER (yr = 1995) AS y1995, max(winner) FILTER (yr = 1996) AS y1996, max(winner) FILTER (yr = 1997) AS y1997 FROM win GROUP BY 1")
def results_matrix_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.matrix(seat_winners(spark, sf_dir), ["c_nationkey"], "yr", [1994, 1995, 1996, 1997], F.max("winner"))


@query(VOTES + ", p AS (SELECT *, lag(winner) OVER (PARTITION BY c_nationkey ORDER BY yr) AS previous FROM win) SELECT c_nationkey, yr, winner, previous, CASE WHEN previous IS NOT NULL THEN previous <> winner END AS changed FROM p")
def winner_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.winner_changes(seat_winners(spark, sf_dir), ["c_nationkey"], "yr").select("c_nationkey", "yr", "winner", "previous", "changed")


@query(VOTES + ", t AS (SELECT *, sum(votes) OVER (PARTITION BY c_nationkey, yr) AS al FROM v), s AS (SELECT c_nationkey, yr, CASE WHEN votes >= 0.15::DOUBLE * al OR c_mktsegment = 'MACHINERY' THEN c_mktsegment ELSE 'Others' END AS name, sum(votes)::BIGINT AS votes, any_value(al) AS al FROM t GROUP BY ALL) SELECT c_nationkey, yr, name, votes, round(votes::DOUBLE / al, 6) AS share FROM s")
def vote_share_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of under 15 % are others; one segment is always shown."""
    return results.shares(segment_votes(spark, sf_dir), ["c_nationkey", "yr"], "c_mktsegment", "votes", 0.15, ["MACHINERY"]).withColumn("share", F.round("share", 6))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1")
def latest_view_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return results.latest(o, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus")


@query("""WITH y AS (SELECT o_custkey % 50 AS grp, year(o_orderdate)::INT AS yr, count(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT grp, yr, lag(n) OVER (PARTITION BY grp ORDER BY yr) AS before, n AS after FROM y)
SELECT grp, yr, before, after, after - before AS delta, round_even((after - before) * 100.0::DOUBLE / before, 2) AS delta_pct, before IS NOT NULL AS available FROM b""")
def change_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    y = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("grp"), F.year("o_orderdate").alias("yr")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("grp").orderBy("yr"))
    return y.withColumn("b", before).select("grp", "yr", change(F.col("b"), F.col("n")).alias("c")).select("grp", "yr", "c.*")


OPTIONS = """, o AS (SELECT row_id, votes, total_valid, row_id % 5 AS rejected, row_id % 3 AS nota FROM c WHERE votes IS NOT NULL AND len(votes) = 3)
"""


@query(ROWS + OPTIONS + """SELECT row_id, CASE WHEN votes[1] + votes[2] + votes[3] = total_valid THEN [votes[1], votes[2], votes[3], total_valid, rejected, nota, total_valid + rejected + nota] END AS reconciled
FROM o""")
def reconcile_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's column is read twice (right, and 1000 too high), the totals once: only the right reading can add up, where the row does."""
    r = vote_rows(spark, sf_dir).filter("votes is not null and size(votes) = 3")
    rej, nota = F.col("row_id") % 5, F.col("row_id") % 3
    text = lambda x: x.cast("string")
    candidates = F.transform("votes", lambda v: F.array(text(v), text(v + 1000)))
    tail = [F.array(text(x)) for x in (F.col("total_valid"), rej, nota, F.col("total_valid") + rej + nota)]
    return r.select("row_id", arrays.reconciled(F.concat(candidates, F.array(*tail))).alias("reconciled"))
