"""Linkage of records across editions: place evidence, decisions, bridges, and joins by one of two keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions import text


def decision(to_part: Column, place_hits: Column, building_hits: Column, most: int = 4) -> Column:
    """Struct of status, part, candidates and reason from the parts that the place and the building point to.

    The named part, or the only one, that both point to is verified; else it stays for review, with up to `most` candidates.
    """
    place, building = F.array_sort(F.array_distinct(place_hits)), F.array_sort(F.array_distinct(building_hits))
    both = F.array_sort(F.array_intersect(place, building))
    near = F.when(F.size(both) > 0, both).otherwise(F.array_sort(F.array_union(place, building)))
    return _decided(to_part, F.array_contains(both, to_part), F.size(place), F.size(building), F.size(both), F.get(both, 0), F.when(F.size(near) <= most, near))


def _decided(to_part: Column, named: Column, place: Column, building: Column, both: Column, only: Column, near: Column) -> Column:
    """See decision. named: whether both point to to_part; place, building, both: how many parts they point to; only: the part where both point to one; near: the candidates, null if they are too many."""
    found = F.when(named, to_part).when(both == 1, only)
    reason = (
        F.when(both > 1, "several stations match place and building")
        .when((place > 0) & (building > 0) & (both == 0), "place and building disagree")
        .when(place > 0, "place only")
        .when(building > 0, "building only")
        .otherwise("neither place nor building match")
    )
    none = F.array().cast("array<bigint>")
    status = F.when(to_part.isNull(), "unmapped").when(found.isNotNull(), "verified").otherwise("review")
    return F.struct(
        status.alias("status"),
        F.when(status == "verified", found.cast("bigint")).alias("part"),
        F.when((status == "review") & near.isNotNull(), near.cast("array<bigint>")).otherwise(none).alias("candidates"),
        F.when(status == "review", reason).alias("reason"),
    )


def place_decisions(mappings: DataFrame, stations: DataFrame, ac: str = "ac_number", most: int = 4) -> DataFrame:
    """mappings (id, ac, area, to_part, building) with decision, by the stations (ac, part_number, text, name, areas) of the same constituency.

    Texts are normalised once for each row. Only different sets of words are compared with different stations' texts; parts of
    equal texts are counted, not listed. The named part is looked up by its number.
    """
    words = ["_place", "_building", "_phrase"]
    m = mappings.select("id", ac, "area", "to_part", "building").distinct()
    m = m.select("id", ac, "to_part", text.place_tokens(F.col("area")).alias("_place"), text.building_tokens(F.col("building")).alias("_building"), F.coalesce(text.building_phrase(F.col("building")), F.lit("")).alias("_phrase"))
    texts = F.struct(text.unspaced(F.coalesce("areas", "text")).alias("areas"), text.unspaced(F.col("text")).alias("text"), text.whole_words(F.col("name")).alias("name"))
    parts = stations.filter(F.col("part_number").isNotNull()).groupBy(ac, "part_number").agg(F.array_sort(F.collect_set(texts)).alias("_texts"))
    place = F.exists("_texts", lambda s: text.place_within(F.col("_place"), s["areas"]))
    phrase = lambda s: (F.col("_phrase") != "") & s["name"].contains(F.col("_phrase"))
    building = F.exists("_texts", lambda s: F.coalesce(text.building_within(F.col("_building"), s["text"]), F.lit(False)) | F.coalesce(phrase(s), F.lit(False)))

    first = F.row_number().over(Window.partitionBy(ac, "_texts").orderBy("part_number")) <= most + 1
    kinds = parts.withColumn("_first", first).groupBy(ac, "_texts").agg(F.count("*").alias("_n"), F.min("part_number").alias("_least"), F.collect_list(F.when(F.col("_first"), F.col("part_number"))).alias("_parts"))
    met = m.select(ac, *words).distinct().join(kinds, ac).withColumn("_p", place).withColumn("_b", building).filter("_p or _b")
    n = lambda x: F.coalesce(F.sum(F.when(x, F.col("_n"))), F.lit(0))
    listed = lambda x: F.array_sort(F.flatten(F.collect_list(F.when(x, F.col("_parts")))))
    p, b = F.col("_p"), F.col("_b")
    hits = met.groupBy(ac, *words).agg(n(p).alias("_np"), n(b).alias("_nb"), n(p & b).alias("_nboth"), F.sum("_n").alias("_nany"), F.min(F.when(p & b, F.col("_least"))).alias("_only"), listed(p & b).alias("_both"), listed(p | b).alias("_any"))
    near = F.when(F.col("_nboth") > 0, F.when(F.col("_nboth") <= most, F.col("_both"))).when(F.col("_nany") <= most, F.col("_any"))
    hits = hits.select(ac, *words, "_np", "_nb", "_nboth", "_only", near.alias("_near"))

    named = m.join(parts.withColumnRenamed("part_number", "to_part"), [ac, "to_part"], "left").select("id", ac, "to_part", *words, F.coalesce(place & building, F.lit(False)).alias("_named"))
    n = lambda c: F.coalesce(c, F.lit(0))
    return named.join(hits, [ac, *words], "left").select("id", ac, "to_part", _decided(F.col("to_part"), F.col("_named"), n("_np"), n("_nb"), n("_nboth"), F.col("_only"), F.col("_near")).alias("decision"))


def bridge(review: DataFrame, rows: DataFrame, stations: DataFrame, least_building: float = 0.5, least: float = 0.6, gap: float = 0.15) -> DataFrame:
    """For review rows (id, ac_number, to_part, building): the current station that a row of a list between the editions points to.

    rows: ac_number, serial, locality, building, areas; stations: ac_number, part_number, name, areas. The list's row must be the only
    one of that serial with the building; the best station must have a score of `least` and lead by `gap`.

    Texts are normalised once for each row. Rows of equal texts are counted and compared once, on all three sides.
    """
    words, key, at = text.overlap_words, ["ac_number", "to_part", "_words"], ["ac_number", "_listed"]
    room = lambda c: F.coalesce(text.room_number(F.col(c)), F.lit(""))
    listed = F.struct(words(F.col("building")).alias("building"), room("building").alias("room"), words(F.col("areas")).alias("areas"))
    r = rows.select("ac_number", F.col("serial").alias("to_part"), text.unspaced(F.concat_ws(" ", "locality", "building")).alias("_row"), listed.alias("_listed"))
    r = r.groupBy("ac_number", "to_part", "_row", "_listed").agg(F.count("*").alias("_k"))
    v = review.select("id", "ac_number", "to_part", words(F.col("building")).alias("_words"))
    near = v.select(key).distinct().join(r, ["ac_number", "to_part"]).filter(text.words_overlap(F.col("_words"), F.col("_row")) >= least_building)
    near = near.groupBy(key).agg(F.sum("_k").alias("_k"), F.first("_listed").alias("_listed"))
    only = v.join(near, key).groupBy("id").agg(F.sum("_k").alias("_k"), F.first("ac_number").alias("ac_number"), F.first("_listed").alias("_listed")).filter("_k = 1").drop("_k")

    s = stations.select("ac_number", "part_number", text.unspaced(F.col("name")).alias("_name"), room("name").alias("_room"), text.unspaced(F.col("areas")).alias("_areas"))
    s = s.groupBy("ac_number", "_name", "_room", "_areas").agg(F.max("part_number").alias("part_number"), F.count("*").alias("_k"))
    a, b = F.col("_listed.room"), F.col("_room")
    score = 0.5 * text.words_overlap(F.col("_listed.building"), F.col("_name")) + 0.5 * text.words_overlap(F.col("_listed.areas"), F.col("_areas"))
    # A station under both limits neither is the best nor stops the best from leading.
    scored = only.select(at).distinct().join(s, "ac_number").filter((a == "") | (b == "") | (a == b)).withColumn("score", score).filter(F.col("score") >= min(least, least - gap) - 1e-9)
    w = Window.partitionBy(at).orderBy(F.desc("score"), F.desc("part_number"))
    after = F.when(F.col("_k") > 1, F.col("score")).otherwise(F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    best = scored.select(*at, "part_number", "score", F.row_number().over(w).alias("_rank"), after.alias("_next")).filter((F.col("_rank") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("_next") >= gap))
    return only.join(best, at).select("id", F.col("part_number").alias("suggested_part"), "score")


def evaluated(mappings: DataFrame, stations: DataFrame, rows: DataFrame, ac: str = "ac_number") -> DataFrame:
    """mappings with status, part (of verified ones), suggestions (parts, for review) and same_number (whether the constituency has a station of that number).

    mappings: id, from_part, ac, area, to_part, building; stations: ac, part_number, text, name, areas; rows: the list between the editions, see bridge.
    The same mapping stored twice counts once, the first by from_part, to_part, id. What the list points to replaces the candidates of a review row; it never verifies one.
    """
    key = [F.col("from_part"), text.normalise(F.col("area")), F.col(ac), F.col("to_part")]
    first = first_of_key(mappings, key, ["from_part", "to_part", "id"])
    d = place_decisions(first, stations, ac).select("id", "decision.*")
    review = first.join(d.filter("status = 'review'").select("id"), "id", "left_semi").select("id", ac, "to_part", "building")
    b = bridge(review, rows, stations).select("id", "suggested_part")
    out = first.join(d, "id").join(b, "id", "left")
    out = out.withColumn("suggestions", F.when(F.col("suggested_part").isNotNull(), F.array(F.col("suggested_part").cast("bigint"))).otherwise(F.col("candidates")))
    numbers = stations.select(ac, F.col("part_number").alias("to_part"), F.lit(True).alias("same_number")).distinct()
    return out.drop("candidates", "suggested_part").join(numbers, [ac, "to_part"], "left").withColumn("same_number", F.coalesce("same_number", F.lit(False)))


def word_share_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, least: float, words: str = "words") -> DataFrame:
    """(left_id, right_id, n, share): pairs in which right has the share `least` or more of left's distinct words; words are arrays without repeats.

    A pair of that share has one of left's rarest words, of as many as may be missing and one more; so pairs meet on those only,
    and are then counted whole. A word that stands everywhere makes no pairs unless a text has hardly another. Pairs without a common word don't appear.
    """
    w = left.select(left_id, F.size(words).alias("_n"), F.explode(words).alias("_w"))
    r = right.select(right_id, F.explode(words).alias("_w"))
    common = r.join(w.select("_w").distinct(), "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy(left_id).orderBy(F.coalesce("_df", F.lit(0)), "_w"))
    may_lack = F.col("_n") - F.ceil(F.col("_n") * F.lit(float(least)) - 1e-9)
    keys = w.join(common, "_w", "left").withColumn("_k", rank).filter(F.col("_k") <= may_lack + 1).select(left_id, "_w")
    pairs = r.join(keys, "_w").select(left_id, right_id).distinct()
    both = pairs.join(left.select(left_id, F.col(words).alias("_a")), left_id).join(right.select(right_id, F.col(words).alias("_b")), right_id)
    n = both.select(left_id, right_id, F.size(F.array_intersect("_a", "_b")).cast("long").alias("n"), F.size("_a").alias("_n"))
    return n.withColumn("share", F.col("n") / F.col("_n")).filter(F.col("share") >= least).drop("_n")


def best_by_gap(pairs: DataFrame, left_id: str, right_id: str, least: float, gap: float) -> DataFrame:
    """The best right of each left, if its share is `least` or more and leads by `gap`; pairs has all of a share of least - gap or more."""
    w = Window.partitionBy(left_id).orderBy(F.desc("share"), F.asc(right_id))
    r = pairs.withColumn("_k", F.row_number().over(w)).withColumn("_second", F.coalesce(F.lead("share").over(w), F.lit(0.0)))
    return r.filter((F.col("_k") == 1) & (F.col("share") >= least) & (F.col("share") - F.col("_second") >= gap)).drop("_k", "_second")


def first_of_key(rows: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """rows without those that repeat a key; the first in order stays."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def unique_or_null(rows: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """For each key its value if exactly one row has the key, else null."""
    return rows.groupBy(*key).agg(F.when(F.count("*") == 1, F.min(value)).alias(value))


def by_id_or_number(children: DataFrame, parents: DataFrame, child_id: str, parent_id: str, number: Sequence[str]) -> DataFrame:
    """Children joined to parents by id, or where that is null by number (unique in parents): two equi-joins and a union, no nested loop."""
    known = children.filter(F.col(child_id).isNotNull())
    by_id = known.join(parents.select(F.col(parent_id).alias("_pid")), known[child_id] == F.col("_pid"), "left").withColumn("linked_id", F.col("_pid")).drop("_pid")
    unique = parents.groupBy(*number).agg(F.when(F.count("*") == 1, F.min(parent_id)).alias("linked_id"))
    by_number = children.filter(F.col(child_id).isNull()).join(unique, list(number), "left").select(*children.columns, "linked_id")
    return by_id.select(*children.columns, "linked_id").unionByName(by_number)


def add_unmapped(mapped: DataFrame, all_keys: DataFrame, key: Sequence[str], status: str = "status", label: str = "Not Mapped") -> DataFrame:
    """mapped and a row for each key that it lacks."""
    rest = all_keys.join(mapped, list(key), "left_anti").withColumn(status, F.lit(label))
    return mapped.unionByName(rest, allowMissingColumns=True)


def matching_totals(columns: DataFrame, candidates: DataFrame, sheet: Sequence[str], column: str, totals: Sequence[str], name: str) -> DataFrame:
    """Names for a sheet's columns by equal totals; all of a sheet's are null unless each column matches one candidate and no two the same."""
    j = columns.join(candidates, [*sheet, *totals], "left").groupBy(*sheet, column).agg(F.count(name).alias("_n"), F.min(name).alias("_name"))
    w = Window.partitionBy(*sheet)
    sound = (F.min(F.col("_n") == 1).over(w)) & (F.size(F.collect_set("_name").over(w)) == F.count("*").over(w))
    return j.withColumn(name, F.when(sound, F.col("_name"))).select(*sheet, column, name)
