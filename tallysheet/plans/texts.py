"""Text functions over documents, parts, orders and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import text
from tallysheet.functions.numbers import indian_grouping, pair_code, pair_number, pair_year, percent_text
from tallysheet.plans.registry import query, table
from tallysheet.sources import html, records


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[0-9०-९\-.,()/:;।\[\]]+', ' ', 'g'), '\s+', ' ', 'g')))) AS normal FROM documents")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalise(F.col("text"))).alias("normal"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" "), "p_type")).alias("slug"))


@query("SELECT p_partkey, nullif(regexp_extract(p_brand, '(\\d+)', 1), '')::BIGINT AS first_int, nullif(regexp_extract(p_name, '^\\s*(\\d+)', 1), '')::BIGINT AS leading_int FROM part")
def first_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.first_int(F.col("p_brand")).alias("first_int"), text.leading_int(F.col("p_name")).alias("leading_int"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open' ELSE o_orderstatus END AS label FROM orders")
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.code_label(F.col("o_orderstatus"), {"F": "Filled", "O": "Open"}, "Unknown").alias("label"))


@query(r"""WITH v AS (SELECT o_orderkey, (o_totalprice * 100)::BIGINT::VARCHAR AS s FROM orders)
SELECT o_orderkey, CASE WHEN length(s) <= 3 THEN s ELSE reverse(regexp_replace(reverse(left(s, length(s) - 3)), '(\d\d)', '\1,', 'g')) || ',' || right(s, 3) END AS raw FROM v""".replace("SELECT o_orderkey, CASE", "SELECT o_orderkey, ltrim(CASE").replace("END AS raw", "END, ',') AS grouped"))
def indian_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", indian_grouping(F.round(F.col("o_totalprice") * 100).cast("long")).alias("grouped"))


@query("SELECT o_orderkey, printf('%.1f%%', (o_custkey % 1000) / 10.0) AS pct, year(o_orderdate)::BIGINT * 1000 + o_custkey % 1000 AS code, year(o_orderdate)::INT AS yr, (o_custkey % 1000)::INT AS num, CASE WHEN o_custkey % 3 = 1 THEN '1 line' ELSE (o_custkey % 3) || ' lines' END AS lines FROM orders")
def formats_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_custkey") % 1000
    code = pair_code(F.year("o_orderdate").cast("long"), n)
    return table(spark, sf_dir, "orders").select("o_orderkey", percent_text(n / 10).alias("pct"), code.alias("code"), pair_year(code).alias("yr"), pair_number(code).alias("num"), text.plural(F.col("o_custkey") % 3, "line").alias("lines"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN c_name || ' ' || c_mktsegment WHEN c_custkey % 4 = 2 THEN c_name END AS joined FROM customer")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    a = F.when(k == 0, "").when(k < 3, F.col("c_name"))
    b = F.when(k < 2, F.col("c_mktsegment")).when(k == 2, "")
    return table(spark, sf_dir, "customer").select("c_custkey", text.joined(a, b).alias("joined"))


@query("SELECT c_custkey, regexp_matches(upper(left(c_mktsegment, 3)) || lpad((c_custkey * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 10000000 END)::VARCHAR, 7, '0'), '^[A-Z]{3}\\d{7}$') OR regexp_matches('UP/1/' || c_custkey || '/7', '^[A-Z]{2}[\\\\/]\\d+[\\\\/]\\d+[\\\\/]\\d+$') AND c_custkey % 5 = 0 AS ok FROM customer")
def id_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    number = k.cast("string")
    wide = (k * F.when(k % 2 == 0, 1).otherwise(10_000_000)).cast("string")
    modern = F.concat(F.upper(F.substring("c_mktsegment", 1, 3)), F.lpad(wide, 7, "0"))
    legacy = F.concat(F.lit("UP/1/"), number, F.lit("/7"))
    return table(spark, sf_dir, "customer").select("c_custkey", (text.id_format(modern) | (text.id_format(legacy) & (k % 5 == 0))).alias("ok"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM a GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(table(spark, sf_dir, "pages")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("""SELECT page_id, len(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1))::BIGINT AS n_rows FROM pages WHERE len(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1)) > 0""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.table_rows(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("n_rows"))


@query("SELECT page_id, (page_id * 3)::BIGINT AS a FROM pages")
def html_embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script with an object is put into each page, and read back."""
    p = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit("<script>const DATA = {\"a\": "), F.col("page_id") * 3, F.lit("};</script>")))
    return p.select("page_id", html.embedded_json(F.col("html"), "DATA", "a long")["a"].alias("a"))


@query("""WITH p AS (SELECT page_id AS doc, 'links' AS layout, len(regexp_extract_all(html, '(?i)<a\\b'))::BIGINT AS matching FROM pages UNION ALL SELECT page_id, 'paragraphs', len(regexp_extract_all(html, '(?i)<p\\b'))::BIGINT FROM pages UNION ALL SELECT page_id, 'items', len(regexp_extract_all(html, '(?i)<li\\b'))::BIGINT FROM pages)
SELECT doc, layout, matching FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY matching DESC, layout) AS k FROM p) WHERE k = 1""")
def layout_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    tags = {"links": r"(?i)<a\b", "paragraphs": r"(?i)<p\b", "items": r"(?i)<li\b"}
    parses = p.select(F.col("page_id").alias("doc"), F.explode(F.array(*[F.struct(F.lit(k).alias("layout"), F.regexp_count("html", F.lit(v)).cast("long").alias("matching")) for k, v in tags.items()])).alias("x")).select("doc", "x.*").withColumn("n", F.col("matching"))
    return records.best_layout(parses).select("doc", "layout", "matching")
