"""Rolls, lists, place evidence and fonts over the driver's tables; made-up columns are arithmetic on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.functions import fonts, numbers, text
from tallysheet.operators import coverage, linkage, quality, reports, search, sequence, store
from tallysheet.plans.registry import query, table
from tallysheet.sources import html, records
from tallysheet.streaming import events

#: The mean of hundredths {0} over {1} rows to 4 decimals, half to even, by whole numbers.
MEAN = "coalesce(({0} * 100 // {1} + CASE WHEN {0} * 100 % {1} * 2 > {1} OR ({0} * 100 % {1} * 2 = {1} AND {0} * 100 // {1} % 2 = 1) THEN 1 ELSE 0 END) / 10000.0::DOUBLE, 0)"

#: Customers as people on the roll of their nation. Every ninth nation has no official count.
PEOPLE = f"""WITH p AS (SELECT c_nationkey AS roll, CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN 'F' WHEN 3 THEN 'O' END AS gender, CASE WHEN c_custkey % 11 > 0 THEN (14 + c_custkey % 90)::INT END AS age, c_custkey // 3 AS serial,
CASE WHEN c_custkey % 4 > 0 THEN 'X' ELSE '' END AS id_number, (c_custkey % 101) / 100.0::DOUBLE AS confidence, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 13 > 0 END AS is_valid, CASE WHEN c_custkey % 17 = 0 THEN 'exact' END AS duplicate_kind,
CASE WHEN c_nationkey % 9 > 0 THEN (c_nationkey % 2 + 1) * 40 ELSE 0 END::BIGINT AS official FROM customer),
s AS (SELECT roll, count(*) AS n, count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender = 'F') AS female, count(*) FILTER (coalesce(gender, '') NOT IN ('M', 'F')) AS other,
count(*) FILTER (age BETWEEN 18 AND 25) AS age_18_25, count(*) FILTER (age BETWEEN 26 AND 40) AS age_26_40, count(*) FILTER (age BETWEEN 41 AND 60) AS age_41_60, count(*) FILTER (age BETWEEN 61 AND 200) AS age_61_up, count(*) FILTER (age IS NULL) AS age_missing,
min(serial) AS min_serial, max(serial) AS max_serial, greatest(coalesce(max(nullif(official, 0)), max(serial)) - min(serial) + 1 - count(DISTINCT serial) FILTER (official = 0 OR serial <= official), 0) AS n_gaps, count(*) FILTER (official > 0 AND serial > official) AS n_outliers,
count(*) FILTER (id_number <> '') AS with_id, max(nullif(official, 0)) AS official, count(*) - max(nullif(official, 0)) AS difference, round((count(*) - max(nullif(official, 0))) * 100.0::DOUBLE / max(nullif(official, 0)), 4) AS diff_pct,
{MEAN.format('sum((confidence * 100)::BIGINT)::BIGINT', 'count(*)')} AS mean_confidence, count(*) FILTER (confidence < 0.95) AS low_confidence, count(*) FILTER (NOT coalesce(is_valid, false)) AS invalid, count(*) FILTER (duplicate_kind IS NOT NULL) AS duplicates FROM p GROUP BY 1)
"""


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        n.alias("roll"), F.get(F.array(*map(F.lit, ("M", "F", "F", "O"))), (k % 5).cast("int")).alias("gender"), F.when(k % 11 > 0, (14 + k % 90).cast("int")).alias("age"), F.floor(k / 3).alias("serial"),
        F.when(k % 4 > 0, "X").otherwise("").alias("id_number"), ((k % 101) / 100.0).alias("confidence"), F.when(k % 7 > 0, k % 13 > 0).alias("is_valid"), F.when(k % 17 == 0, "exact").alias("duplicate_kind"),
        F.when(n % 9 > 0, (n % 2 + 1) * 40).otherwise(0).cast("long").alias("official"),
    )


@query(PEOPLE + "SELECT * FROM s")
def booth_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.roll_stats(people(spark, sf_dir), ["roll"])


BAND = "printf('  %-6s ', '{0}') || lpad(printf('%,d', {1}), 6, ' ') || '  (' || printf('%5.1f', round_even({1} * 100.0::DOUBLE / n, 1)) || '%)'"
BANDS = ", ".join(BAND.format(k, c) for k, c in (("18-25", "age_18_25"), ("26-40", "age_26_40"), ("41-60", "age_41_60"), ("61+", "age_61_up")))
NUM = "printf('%-18s', '{0}') || lpad(printf('%,d', {1}), 10, ' ')"


@query(PEOPLE + f"""SELECT roll, concat_ws(chr(10), 'Roll ' || roll, {NUM.format('Extracted:', 'n')}, {NUM.format('  Male:', 'male')}, {NUM.format('  Female:', 'female')}, {NUM.format('  Other:', 'other')}, {BANDS},
CASE WHEN age_missing > 0 THEN '  n/a    ' || lpad(printf('%,d', age_missing), 6, ' ') END, 'Serials: ' || min_serial || '-' || max_serial || ', gaps: ' || n_gaps || CASE WHEN n_outliers > 0 THEN ', stray: ' || n_outliers ELSE '' END,
CASE WHEN official IS NULL THEN 'Official:            unknown' ELSE {NUM.format('Official:', 'official')} END, CASE WHEN difference IS NULL THEN 'Difference: n/a' ELSE 'Difference: ' || CASE WHEN difference >= 0 THEN '+' ELSE '' END || difference END,
{NUM.format('Failing checks:', 'invalid')}, {NUM.format('Duplicates:', 'duplicates')}) AS report FROM s""")
def roll_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.roll_stats(people(spark, sf_dir), ["roll"])
    return s.select("roll", reports.roll_text(F.concat(F.lit("Roll "), "roll")).alias("report"))


@query("""WITH l AS (SELECT l_suppkey AS list, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 50 + l_suppkey END AS number FROM lineitem GROUP BY ALL), c AS (SELECT list, count(number) AS n, coalesce(count(number)::DOUBLE / (max(number) - min(number) + 1), 0) AS coverage FROM l GROUP BY 1)
SELECT list, n, round(coverage, 6) AS coverage, CASE WHEN coverage < 0.9 THEN 'numbers missing' WHEN list % 7 > 0.1 * 50 THEN 'stations missing' END AS gate FROM c""")
def list_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("list"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 50 + F.col("l_suppkey")).alias("number")).distinct()
    c = reports.serial_coverage(li, ["list"], "number")
    return c.select("list", "n", F.round("coverage", 6).alias("coverage"), reports.list_gate(F.col("coverage"), F.lit(50), F.col("list") % 7).alias("gate"))


@query("""WITH v AS (SELECT l_suppkey AS sheet, l_partkey % 3 AS col, sum(l_quantity)::BIGINT AS s FROM lineitem GROUP BY ALL), t AS (SELECT l_suppkey AS sheet, (count(*) * 9)::BIGINT AS total FROM lineitem GROUP BY 1)
SELECT sheet, list(col::INT ORDER BY col) AS columns FROM v JOIN t USING (sheet) WHERE s > total + col GROUP BY 1""")
def column_over_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as booths of their supplier's sheet, quantities as votes in one of three columns."""
    q, c = F.col("l_quantity").cast("long"), F.col("l_partkey") % 3
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.array(*[F.when(c == i, q).otherwise(0) for i in range(3)]).alias("votes"))
    t = li.groupBy("sheet").agg((F.count("*") * 9).alias("n")).select("sheet", F.array(*[F.col("n") + i for i in range(3)]).alias("votes"))
    return reports.over_read(li, t, ["sheet"])


@query(f"WITH s AS (SELECT user_id, sum(event_id % 89)::BIGINT AS s, count(*) AS n FROM events WHERE event_id % 4 > 1 GROUP BY 1) SELECT user_id, {MEAN.format('s', 'n')} AS mean_confidence FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 4 - 1).alias("words"), (F.col("event_id") % 89 / 100.0).alias("confidence"))
    return reports.mean_confidence(e, ["user_id"])


@query("SELECT lang, CASE WHEN count(*) = 0 THEN NULL WHEN sum(len(regexp_replace(coalesce(text, ''), '[^qxz]', '', 'g'))) >= sum(len(regexp_replace(coalesce(text, ''), '[^üßñ]', '', 'g'))) THEN 'A' ELSE 'B' END AS font FROM documents GROUP BY 1")
def font_by_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters as the signs of two fonts."""
    return fonts.font_of(table(spark, sf_dir, "documents"), ["lang"], "text", {"A": "qxz", "B": "üßñ"}).select("lang", "font")


TYPED, GLYPHED = "abcdefghijklmnopqrstuvwxyz", "कखगघàि¢जझन्तमसहरवÛȣलͪपदब[È"
VISUAL = f"translate(p_name || ' ' || lower(p_type), '{TYPED}', '{GLYPHED}')"
for _k, _v in fonts.VISUAL_GLYPHS.items():
    VISUAL = f"replace({VISUAL}, '{_k}', '{_v}')"
VISUAL = f"regexp_replace(replace({VISUAL}, 'घालय', 'द्यालय'), '[{fonts.VISUAL_SHORT_I}]', 'ि', 'g')"
SPACED = f"(?:[{fonts.CONSONANTS}]्)*[{fonts.CONSONANTS}]़?"


@query(rf"SELECT p_partkey, regexp_replace(regexp_replace({VISUAL}, 'ि[\t\n\v\f\r ]*({SPACED})', '\1ि', 'g'), '({SPACED})\[', 'र्\1', 'g') AS repaired FROM part")
def visual_order_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names typed in the glyphs of the font in visual order."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fonts.visual_repaired(F.translate(F.concat("p_name", F.lit(" "), F.lower("p_type")), TYPED, GLYPHED)).alias("repaired"))


ORDERED = f"translate(p_name || ' NULL ' || lower(p_type), '{TYPED}', 'कखगघिचछजझन्तमसहरवािलीपदबयŊ')"


@query(rf"""WITH t AS (SELECT p_partkey, replace({ORDERED}, 'Ŋ', 'र्') AS t FROM part), o AS (SELECT p_partkey, regexp_replace(regexp_replace(t, 'ि({fonts.CLUSTER})', '\1ि', 'g'), '([{fonts.CONSONANTS}])([{fonts.SIGNS}]*)र्', 'र्\1\2', 'g') AS t FROM t)
SELECT p_partkey, t AS repaired, round(1 - len(regexp_replace(t, '[^ीप]', '', 'g'))::DOUBLE / len(t), 6) AS sure FROM (SELECT p_partkey, trim(regexp_replace(replace(t, ' NULL ', '   '), '\s+', ' ', 'g')) AS t FROM o)""")
def font_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names typed with signs before and behind their consonants; two letters stand for what wasn't decoded."""
    typed = F.translate(F.concat("p_name", F.lit(" NULL "), F.lower("p_type")), TYPED, "कखगघिचछजझन्तमसहरवािलीपदबयŊ")
    p = table(spark, sf_dir, "part").select("p_partkey", fonts.repaired(typed, {"Ŋ": "र्"}, "[\\x{0300}-\\x{036f}]").alias("repaired"))
    return p.withColumn("sure", F.round(fonts.decoded_share(F.col("repaired"), "[ीप]"), 6))


NORM = r"lower(trim(regexp_replace(regexp_replace({0}, '[0-9.,()/:;\[\]-]+', ' ', 'g'), '\s+', ' ', 'g')))"
HAS = "len(list_filter({0}, lambda w: NOT contains({1}, w))) = 0"


@query(f"""WITH m AS (SELECT p_partkey AS id, p_size AS ac, list_filter(string_split({NORM.format('p_name')}, ' '), lambda w: len(w) >= 2) AS area, CASE WHEN p_partkey % 9 > 0 THEN p_partkey - p_partkey % 5 END AS to_part,
list_filter(string_split({NORM.format("p_type || ' ' || p_brand")}, ' '), lambda w: len(w) >= 3) AS building, {NORM.format("p_type || ' ' || p_brand")} AS phrase FROM part),
s AS (SELECT p_size AS ac, p_partkey AS part, replace({NORM.format("p_name || ' ' || p_brand || p_type")}, ' ', '') AS hay, ' ' || {NORM.format("p_type || ' ' || p_brand || ' hall'")} || ' ' AS name FROM part WHERE p_partkey % 10 = 0),
h AS (SELECT id, to_part, coalesce(list_sort(list(DISTINCT part) FILTER (part IS NOT NULL AND {HAS.format('area', 'hay')})), []) AS p, coalesce(list_sort(list(DISTINCT part) FILTER (part IS NOT NULL AND (len(list_filter(building, lambda w: contains(hay, w))) >= 0.75 * len(building) OR contains(name, ' ' || phrase || ' ')))), []) AS b FROM m LEFT JOIN s USING (ac) GROUP BY ALL),
i AS (SELECT *, list_sort(list_intersect(p, b)) AS bth FROM h)
SELECT id, CASE WHEN to_part IS NULL THEN 'unmapped' WHEN list_contains(bth, to_part) OR len(bth) = 1 THEN 'verified' ELSE 'review' END AS status, CASE WHEN to_part IS NULL THEN NULL WHEN list_contains(bth, to_part) THEN to_part WHEN len(bth) = 1 THEN bth[1] END AS part,
CASE WHEN to_part IS NOT NULL AND NOT (list_contains(bth, to_part) OR len(bth) = 1) THEN CASE WHEN len(bth) > 1 THEN 'several stations match place and building' WHEN len(p) > 0 AND len(b) > 0 THEN 'place and building disagree' WHEN len(p) > 0 THEN 'place only' WHEN len(b) > 0 THEN 'building only' ELSE 'neither place nor building match' END END AS reason FROM i""")
def place_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as mappings and, each tenth of them, as stations of their size."""
    p = table(spark, sf_dir, "part")
    k, building = F.col("p_partkey"), F.concat("p_type", F.lit(" "), "p_brand")
    m = p.select(k.alias("id"), F.col("p_size").alias("ac_number"), F.col("p_name").alias("area"), F.when(k % 9 > 0, k - k % 5).alias("to_part"), building.alias("building"))
    s = p.filter(k % 10 == 0).select(F.col("p_size").alias("ac_number"), k.alias("part_number"), F.concat("p_name", F.lit(" "), "p_brand", "p_type").alias("text"), F.concat(building, F.lit(" hall")).alias("name"), F.lit(None).cast("string").alias("areas"))
    return linkage.place_decisions(m, s).select("id", "decision.status", "decision.part", "decision.reason")


LAP = "(len(list_filter({0}, lambda w: contains({1}, w)))::DOUBLE / len({0}))"
WORDS3 = "list_distinct(list_filter(string_split({0}, ' '), lambda w: len(w) >= 3))"


@query(f"""WITH v AS (SELECT p_partkey AS id, p_size AS ac, p_partkey % 7 AS serial, {WORDS3.format(NORM.format("p_name || ' ' || p_type"))} AS building, replace({NORM.format("p_brand || ' ' || p_name || ' ' || p_type")}, ' ', '') AS row_hay, {WORDS3.format(NORM.format("p_type || ' ' || p_brand || ' ' || p_name"))} AS areas FROM part),
s AS (SELECT p_size AS ac, p_partkey AS part, replace({NORM.format("p_name || ' ' || p_type")}, ' ', '') AS name, replace({NORM.format("p_brand || p_name")}, ' ', '') AS areas FROM part WHERE p_partkey % 5 = 0),
n AS (SELECT a.id, any_value(b.building) AS building, any_value(b.areas) AS areas, any_value(a.ac) AS ac FROM v a JOIN v b ON a.ac = b.ac AND a.serial = b.serial AND b.id % 4 = 0 AND {LAP.format('a.building', 'b.row_hay')} >= 0.5 GROUP BY a.id HAVING count(*) = 1),
g AS (SELECT id, part, 0.5::DOUBLE * {LAP.format('building', 's.name')} + 0.5::DOUBLE * {LAP.format('n.areas', 's.areas')} AS score FROM n JOIN s USING (ac)),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS next FROM g WINDOW w AS (PARTITION BY id ORDER BY score DESC, part DESC)) SELECT id, part AS suggested_part, round(score, 6) AS score FROM r WHERE k = 1 AND score >= 0.6 AND score - next >= 0.15""")
def list_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as review rows, each fourth as a row of the list between, each fifth as a current station; sizes are constituencies."""
    p, k, ac = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").alias("ac_number")
    building = F.concat_ws(" ", "p_name", "p_type")
    review = p.select(k.alias("id"), ac, (k % 7).alias("to_part"), building.alias("building"))
    rows = p.filter(k % 4 == 0).select(ac, (k % 7).alias("serial"), F.col("p_brand").alias("locality"), building.alias("building"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("areas"))
    stations = p.filter(k % 5 == 0).select(ac, k.alias("part_number"), building.alias("name"), F.concat("p_brand", "p_name").alias("areas"))
    return linkage.bridge(review, rows, stations).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT l_orderkey AS g, l_linenumber AS serial, l_orderkey * 1000 + l_partkey % 1000 AS id, CASE WHEN l_quantity < 9 THEN l_linenumber % 3 + 1 END AS dup FROM lineitem)
SELECT d.id, min(o.id) AS original_id FROM r d JOIN r o ON o.g = d.g AND o.serial = d.dup AND o.id <> d.id GROUP BY 1""")
def duplicates_linked_in_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("serial"), (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("id"), F.when(F.col("l_quantity") < 9, F.col("l_linenumber") % 3 + 1).alias("dup"))
    return quality.linked_duplicates(r, "g", "serial", "dup")


@query("""WITH p AS (SELECT c_custkey AS id, c_nationkey AS roll, CASE WHEN c_custkey % 37 > 0 THEN c_custkey // 2 END AS serial, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE 'N' || c_custkey % 3 END AS name, CASE WHEN c_custkey % 29 > 0 THEN (17 + c_custkey % 8)::INT END AS age, c_mktsegment AS rel,
c_custkey % 11 = 0 AS no_gender, c_custkey % 13 = 0 AS no_relation, c_custkey % 31 = 0 AS bad_id, c_custkey % 19 = 0 AS bad_part FROM customer),
e AS (SELECT *, row_number() OVER (PARTITION BY roll, serial ORDER BY id) AS k, row_number() OVER f AS j, first_value(serial) OVER f AS of FROM p WINDOW f AS (PARTITION BY roll, lower(trim(name)), lower(rel), age ORDER BY id)),
x AS (SELECT *, serial IS NOT NULL AND k > 1 AS exact, trim(name) <> '' AND age IS NOT NULL AND j > 1 AS fuzzy FROM e),
m AS (SELECT *, list_filter([CASE WHEN serial IS NULL THEN 'serial missing' END, CASE WHEN trim(name) = '' THEN 'name missing' END, CASE WHEN age NOT BETWEEN 18 AND 120 THEN 'age out of range' END, CASE WHEN no_gender THEN 'gender unknown' END, CASE WHEN no_relation THEN 'relation unknown' END, CASE WHEN bad_id THEN 'id format' END,
CASE WHEN bad_part THEN 'part number mismatch' END, CASE WHEN exact THEN 'duplicate serial ' || serial END, CASE WHEN fuzzy THEN 'same person as serial ' || coalesce(of::VARCHAR, '?') END], lambda s: s IS NOT NULL) AS v FROM x)
SELECT id, array_to_string(v, '; ') AS validation_notes, len(v) = 0 AS is_valid, CASE WHEN fuzzy THEN 'fuzzy' WHEN exact THEN 'exact' END AS duplicate_kind, CASE WHEN fuzzy THEN of WHEN exact THEN serial END AS duplicate_of FROM m""")
def validation_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the nine rules fires for some customers."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("roll"), F.when(k % 37 > 0, F.floor(k / 2)).alias("serial"), F.when(k % 41 == 0, " ").otherwise(F.concat(F.lit("N"), k % 3)).alias("name"), F.when(k % 29 > 0, (17 + k % 8).cast("int")).alias("age"),
        F.col("c_mktsegment").alias("relative_name"), F.when(k % 11 > 0, F.when(k % 2 == 0, "male").otherwise("W")).alias("gender"), F.when(k % 13 > 0, "FATHER").otherwise("AUNT").alias("relative_type"),
        F.when(k % 31 == 0, "AB12").when(k % 3 == 0, "").otherwise(F.concat(F.lit("abc"), F.lpad((k % 10000000).cast("string"), 7, "0"))).alias("id_number"), (k % 7).alias("part_number"), F.when(k % 19 == 0, k % 7 + 1).otherwise(k % 7).alias("expected"),
    )
    return quality.validated(p, roll="roll", pos="id", expected_part="expected").select("id", "validation_notes", "is_valid", "duplicate_kind", "duplicate_of")


SUGGESTED = "list_filter([{{'part': l_suppkey, 'station': l_suppkey + 100, 'name': 'S' || l_suppkey}}, {{'part': l_suppkey + 1, 'station': l_suppkey + 101, 'name': 'S' || (l_suppkey + 1)}}], lambda s: s.part % 3 > 0)".replace("{{", "{").replace("}}", "}")


@query(f"""WITH l AS (SELECT l_partkey % 40 AS ac, l_partkey AS part, l_suppkey, CASE WHEN l_discount < 0.025 THEN 'verified' WHEN l_discount < 0.055 THEN 'review' WHEN l_discount < 0.075 THEN 'unmapped' END AS said, l_suppkey % 4 > 0 AS linked, {SUGGESTED} AS sug, l_returnflag AS reason FROM lineitem WHERE l_partkey % 5 > 0 AND l_partkey % 40 > 3),
m AS (SELECT *, CASE WHEN said = 'verified' AND linked THEN 'Verified' WHEN said = 'unmapped' THEN 'Not Mapped' ELSE 'Review Required' END AS label FROM l)
SELECT ac AS hist_ac, part AS hist_part, label, CASE WHEN label = 'Verified' THEN 'Part ' || l_suppkey WHEN label = 'Review Required' AND len(sug) > 0 THEN 'Possible: Part ' || array_to_string(list_transform(sug, lambda s: s.part), ', ') END AS current_part,
CASE WHEN label = 'Verified' THEN l_suppkey + 100 WHEN label = 'Review Required' AND len(sug) = 1 THEN sug[1].station END AS current_station, CASE WHEN label = 'Verified' THEN 'S' || l_suppkey WHEN label = 'Review Required' AND len(sug) = 1 THEN sug[1].name END AS current_area,
CASE WHEN label = 'Review Required' THEN 'New roll: Part ' || l_suppkey || '. ' || reason ELSE reason END AS note, CASE label WHEN 'Verified' THEN 1 WHEN 'Review Required' THEN 2 ELSE 3 END::BIGINT AS rank FROM m
UNION ALL SELECT p_partkey % 40, p_partkey, 'Not Mapped', NULL, NULL, NULL, 'No mapping is loaded for this part.', 3 FROM part WHERE p_partkey % 40 IN (SELECT ac FROM l) AND p_partkey NOT IN (SELECT part FROM l)""")
def mapping_rows_of_constituency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("l_discount"), F.col("l_suppkey")
    of = lambda n: F.struct(n.alias("part"), (n + 100).alias("station"), F.concat(F.lit("S"), n).alias("name"))
    m = table(spark, sf_dir, "lineitem").filter("l_partkey % 5 > 0 and l_partkey % 40 > 3").select(
        (F.col("l_partkey") % 40).alias("hist_ac"), F.col("l_partkey").alias("hist_part"), F.when(d < 0.025, "verified").when(d < 0.055, "review").when(d < 0.075, "unmapped").alias("status"), s.alias("to_part"), s.alias("linked_part"),
        F.when(s % 4 > 0, s + 100).alias("linked_station"), F.concat(F.lit("S"), s).alias("linked_name"), F.col("l_returnflag").alias("reason"), F.filter(F.array(of(s), of(s + 1)), lambda x: x["part"] % 3 > 0).alias("suggestions"),
    )
    return reports.mapping_table(m, table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("hist_ac"), F.col("p_partkey").alias("hist_part")))


@query("SELECT c_nationkey, count(*) AS without_orders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def hierarchy_gap_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return coverage.missing_children(c, o, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("without_orders"))


@query("SELECT page_id, 0 AS row, ['n', page_id::VARCHAR] AS cells FROM pages UNION ALL SELECT page_id, 1, ['url ' || page_id] FROM pages")
def html_tables_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table put behind each page: header and data cells, a tag inside a cell."""
    k = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("<table><tr class=x><th>n</th><td> "), k, F.lit(" </td></tr><TR><td>url <b>"), k, F.lit("</b></td></TR></table>")).alias("html"))
    return html.table_rows(p)


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""WITH n AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, l_linenumber, count(DISTINCT l_orderkey) AS rows_with FROM lineitem JOIN n USING (l_suppkey) GROUP BY l_suppkey, l_linenumber, n HAVING count(DISTINCT l_orderkey) >= 0.15 * n""")
def values_in_most_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dense_values(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "l_linenumber", share=0.15)


@query("SELECT c_custkey, CASE WHEN avg(CASE WHEN c_acctbal > 500 THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY c_nationkey) >= 0.8 THEN c_mktsegment END AS trusted FROM customer")
def trusted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of nations where four of five customers have a balance of over 500."""
    return sequence.trusted(table(spark, sf_dir, "customer"), ["c_nationkey"], F.col("c_acctbal") > 500, "c_mktsegment").select("c_custkey", F.col("c_mktsegment").alias("trusted"))


@query("""WITH l AS (SELECT o_custkey % 50 AS k, o_orderstatus = 'F' AS ok, 'v' || o_orderkey % 3 AS version FROM orders) SELECT c_custkey AS k FROM customer WHERE c_custkey < 60 AND c_custkey NOT IN (SELECT k FROM l WHERE ok AND version = 'v1')""")
def pending_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), (F.col("o_orderstatus") == "F").alias("ok"), F.concat(F.lit("v"), F.col("o_orderkey") % 3).alias("version"))
    return coverage.pending(table(spark, sf_dir, "customer").filter("c_custkey < 60").select(F.col("c_custkey").alias("k")), led, ["k"], "v1")


@query(r"""SELECT user_id, avg(len(props)) FILTER (i <= 5) >= 9 AS is_text, count(*) FILTER (len(props) < 9) * 2 > count(*) AS mostly_images FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) GROUP BY 1""")
def text_or_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of their user's document, the length of their properties as characters."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("page"), F.length("props").alias("chars"))
    return records.is_text(e, doc="user_id", least=9)


@query("""WITH c AS (SELECT c_nationkey AS sheet, 0 AS col, c_custkey::VARCHAR AS value FROM customer UNION ALL SELECT c_nationkey, 1, c_mktsegment FROM customer UNION ALL SELECT c_nationkey, 2, ' ' FROM customer UNION ALL SELECT c_nationkey, 3, '1,000' FROM customer),
p AS (SELECT sheet, col, count(nullif(trim(value), '')) AS filled, count(DISTINCT nullif(trim(value), '')) AS distinct_values, avg(CASE WHEN regexp_full_match(trim(replace(value, ',', '')), '\\d+') THEN 1 ELSE 0 END) AS s FROM c GROUP BY ALL)
SELECT sheet, col, filled, distinct_values, CASE WHEN filled = 0 THEN 'empty' WHEN distinct_values = 1 THEN 'const' WHEN s >= 0.8 THEN 'var' ELSE 'text' END AS kind FROM p""")
def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = [F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.lit(" "), F.lit("1,000")]
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("sheet"), F.posexplode(F.array(*cells)).alias("col", "value"))
    return records.column_profile(c, ["sheet"]).drop("number_share")


@query(r"""SELECT p_partkey, greatest(5, least(9, p_size)) AS clamped, regexp_replace(translate(p_name || p_brand, 'oODQ', '0000'), '[^0-9]', '', 'g') AS digits, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_brand END AS label, CASE WHEN p_type = 'ECONOMY' THEN 'ECO' ELSE p_type END AS canonical,
replace(replace(p_name, ' ', '%20'), '#', '%23') || '/' || replace(p_brand, '#', '%23') AS path, len(regexp_replace(p_name || p_type, '\s', '', 'g')) >= 20 AND len(regexp_replace(p_name || p_type, '[^A-Za-z]', '', 'g')) >= 0.55 * len(regexp_replace(p_name || p_type, '\s', '', 'g')) AS legacy FROM part""")
def text_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", numbers.clamp(F.col("p_size"), 5, 9).cast("int").alias("clamped"), text.seen_digits(F.concat("p_name", "p_brand")).alias("digits"), text.first_label(F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(""), F.col("p_brand")).alias("label"),
        text.canonical(F.col("p_type"), {"ECONOMY": "ECO"}).alias("canonical"), text.percent_encoded_path(F.col("p_name"), F.col("p_brand")).alias("path"), text.legacy_font(F.concat("p_name", "p_type")).alias("legacy"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS at FROM orders")
def dates_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("""WITH o AS (SELECT c_custkey % 40 AS ac, CASE WHEN c_custkey % 6 > 0 THEN c_custkey // 40 END AS part, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS state, c_name AS v FROM customer),
n AS (SELECT p_partkey % 40 AS ac, CASE WHEN p_partkey % 7 > 0 THEN p_partkey // 40 END AS part, p_size % 2 + 1 AS state, p_name AS v FROM part)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ac = o.ac AND n.part IS NOT DISTINCT FROM o.part AND (o.state IS NULL OR o.state = n.state)) UNION ALL SELECT * FROM n""")
def upsert_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, k = F.col("c_custkey"), F.col("p_partkey"), lambda x: F.floor(x / 40)
    old = table(spark, sf_dir, "customer").select((c % 40).alias("ac"), F.when(c % 6 > 0, k(c)).alias("part"), F.when(c % 3 > 0, c % 3).alias("state"), F.col("c_name").alias("v"))
    new = table(spark, sf_dir, "part").select((p % 40).alias("ac"), F.when(p % 7 > 0, k(p)).alias("part"), (F.col("p_size") % 2 + 1).cast("long").alias("state"), F.col("p_name").alias("v"))
    return store.upsert_in_state(old, new, ["ac", "part"], "state")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def never_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return coverage.unattempted(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), o.filter("o_orderstatus = 'P'"), o.filter("o_orderpriority = '5-LOW'"), ["k"])


@query("SELECT strftime(time_bucket(INTERVAL 12 hours, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 hours * i, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS i) GROUP BY ALL")
def event_windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that begin each twelve hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.windowed_counts(e, "1 day", slide="12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 hours THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 6 hours) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = events.sessions(e, "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT page_id, page_id::INT AS number, 'N ' || page_id AS name, '/p/' || page_id AS href FROM pages")
def html_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid put behind each page: a header row, an entry, and the pager's row."""
    k = F.col("page_id").cast("string")
    rows = F.concat(F.lit("<table><tr><th>No</th></tr><tr><td> "), k, F.lit("</td><td><b>N</b> "), k, F.lit("</td><td><a class='x' href='/p/"), k, F.lit("'>show</a></td></tr><tr><td>1</td><td><a href=\"javascript:x('Page$2')\">2</a></td></tr></table>"))
    return html.grid_entries(table(spark, sf_dir, "pages").select("page_id", rows.alias("html")))


@query("""WITH l AS (SELECT p_partkey, p_name || ' ' || p_size || CASE WHEN p_partkey % 4 = 0 THEN ' and 7' ELSE '' END AS label, '/p/' || p_partkey AS href FROM part),
s AS (SELECT p_partkey, label, href, list_distinct([p_size] || CASE WHEN p_partkey % 4 = 0 THEN [7] ELSE [] END) AS seen, p_name FROM l JOIN part USING (p_partkey)),
h AS (SELECT *, list_filter(seen, lambda n: n BETWEEN 5 AND 9) AS d, list_filter(seen, lambda n: n IN (20, 30) AND contains(p_name, CASE n WHEN 20 THEN 'cold' ELSE 'hot' END)) AS s FROM s)
SELECT p_partkey, CASE WHEN len(d) = 1 THEN d[1] ELSE s[1] END AS number FROM h WHERE len(d) = 1 OR (len(d) = 0 AND len(s) = 1)""")
def links_to_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    found = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_size", F.when(k % 4 == 0, " and 7").otherwise("")).alias("label"), F.concat(F.lit("/p/"), k).alias("href"))
    names = F.create_map(F.lit(20), F.array(F.lit("COLD")), F.lit(30), F.array(F.lit("hot")))
    return html.attributed(found, F.array(*map(F.lit, range(5, 10))), state_names=names).select("p_partkey", "number")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN '0' ELSE '' END || p_size || '/' || CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END || '-' || p_name AS path FROM part")
def padded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(text.padded(F.col("p_size"), 2), F.lit("/"), text.padded(F.col("p_partkey"), 3), F.lit("-"), "p_name").alias("path"))
