"""Overviews made of several operators: mapping status, changes between editions, review rows, scopes and defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.functions.numbers import percent
from tallysheet.functions.parties import same_party

#: Labels of a mapping's status, in the order they are shown.
STATUS_LABELS = ("Verified", "Review Required", "Not Mapped")


def status_label(status: Column) -> Column:
    """Only `verified` and `unmapped` have labels of their own; anything else, null too, is for review."""
    return F.when(status == "verified", STATUS_LABELS[0]).when(status == "unmapped", STATUS_LABELS[2]).otherwise(STATUS_LABELS[1])


def status_counts(rows: DataFrame, by: Sequence[str], status: str = "status") -> DataFrame:
    """For each group a column for each label, 0 where it has none."""
    label = status_label(F.col(status))
    return rows.groupBy(*by).agg(*[F.count_if(label == x).alias(x.lower().replace(" ", "_")) for x in STATUS_LABELS])


def summed(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the sum of each column, 0 for an empty table."""
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def scoped(state: Column, default: Column | int) -> Column:
    """The state, or the default one where it is null."""
    return F.coalesce(state, default if isinstance(default, Column) else F.lit(default))


def in_state(rows: DataFrame, state: str, wanted: int, default: int) -> DataFrame:
    """Rows of a state; those without one belong to the default state."""
    return rows.filter(scoped(F.col(state), default) == wanted)


def registry_rank(name: Column, registry: Sequence[str]) -> Column:
    """The place of a name in a fixed list; unknown names come after all."""
    at = F.array_position(F.array(*map(F.lit, registry)), name)
    return F.when(at > 0, at).otherwise(F.lit(len(registry) + 1).cast("bigint"))


def wanted_numbers(rows: DataFrame, number: str, numbers: Sequence[int]) -> DataFrame:
    """Rows of the numbers; all rows if no number is named."""
    return rows.filter(F.col(number).isin(*numbers)) if numbers else rows


def source_in_state(source: Column, shared_unless: str, own: Sequence[str]) -> Column:
    """A source without the prefix of state sources is shared; one with it must begin with one of the state's own prefixes."""
    mine = F.lit(False)
    for p in own:
        mine = mine | source.startswith(p)
    return ~source.startswith(shared_unless) | mine


def one_by_number(rows: DataFrame, number: Sequence[str], id_col: str = "id") -> DataFrame:
    """The row of least id for each number."""
    return rows.groupBy(*number).agg(F.min(id_col).alias(id_col))


def names_by_number(rows: DataFrame, by: Sequence[str], number: str, names: Sequence[str]) -> DataFrame:
    """For each group a map from number to its names that are neither null nor empty; a number that stands twice keeps the first names in order."""
    listed = F.filter(F.array(*names), lambda x: x.isNotNull() & (x != ""))
    first = rows.groupBy(*by, number).agg(F.min(F.struct(listed.alias("names"))).alias("_n"))
    return first.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(number), F.col("_n.names"))))).alias("names"))


def results_of(acs: DataFrame, rows: DataFrame, ac_id: str, number: str, state: str) -> DataFrame:
    """Result rows joined to constituencies (id, number, state): by id, and rows without an id by number and state. The state counts only where the id is null."""
    keys = acs.select(F.col(ac_id).alias("_id"), F.col(number).alias("_number"), F.col(state).alias("_state"))
    with_id = rows.filter(F.col(ac_id).isNotNull()).join(keys, F.col(ac_id) == F.col("_id"))
    without = rows.filter(F.col(ac_id).isNull()).join(keys, (F.col(number) == F.col("_number")) & (F.col(state) == F.col("_state")))
    return with_id.unionByName(without).select(*rows.columns, F.col("_id").alias("linked_ac"))


def station_status(station_rows: DataFrame, station: Sequence[str], status: str = "status") -> DataFrame:
    """A station's status by its mapping rows: verified if one is, else review if one is, else none; and how many rows are verified."""
    v, r = F.count_if(F.col(status) == "verified"), F.count_if(F.col(status) == "review")
    return station_rows.groupBy(*station).agg(F.count("*").alias("rows"), v.alias("verified"), F.when(v > 0, "verified").when(r > 0, "review").otherwise("none").alias("mapping_status"))


def historical_status(results: Column) -> Column:
    """Results of an old election never link to a station by its number: there are some (unlinked) or none."""
    return F.when(F.coalesce(results, F.lit(0)) > 0, "unlinked").otherwise("none")


def changes(mappings: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each old part: its mapping rows, the distinct new parts in order, whether it is split, and the villages of each new station it is verified at.

    mappings: by, id, to_part, status, linked_station, area. Rows are counted as they are; nulls are no parts.
    """
    parts = mappings.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.array_sort(F.collect_set("to_part")).alias("targets"),
        F.count_if(status_label(F.col("status")) == STATUS_LABELS[0]).alias("verified"),
        F.count_if(status_label(F.col("status")) == STATUS_LABELS[1]).alias("review"),
    )
    near = mappings.filter("linked_station is not null").groupBy(*by, "linked_station").agg(F.array_sort(F.collect_list(F.struct("id", "area"))).alias("_v"))
    near = near.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("linked_station").alias("station"), F.transform("_v", lambda x: x["area"]).alias("villages")))).alias("stations"))
    out = parts.join(near, list(by), "left").withColumn("split", F.size("targets") > 1)
    return out.withColumn("stations", F.coalesce("stations", F.array().cast(near.schema["stations"].dataType)))


def change_totals(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums over the groups of changes."""
    return groups.groupBy(*by).agg(F.count("*").alias("parts"), F.count_if("split").alias("split_parts"), F.sum("rows").alias("mapping_rows"), F.sum("verified").alias("verified"), F.sum("review").alias("review"))


def constituency_overview(stations: DataFrame, records: DataFrame, mappings: DataFrame, ac: str, station: str) -> DataFrame:
    """For each constituency: stations, those with records, their share, editions, and its mapping rows by label.

    records: one row for each station with total; mappings: ac, status. Each side is aggregated before it is joined.
    """
    s = stations.join(records.select(station, "total"), station, "left")
    s = s.groupBy(ac).agg(F.count("*").alias("stations"), F.count("total").alias("with_roll"), F.coalesce(F.sum("total"), F.lit(0)).alias("records"), F.array_sort(F.collect_set("edition")).alias("editions"))
    m = status_counts(mappings, [ac])
    names = m.columns[1:]
    out = s.join(m, ac, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})
    return out.withColumn("coverage_pct", percent(F.col("with_roll"), F.col("stations")))


def most_frequent(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The key with most rows in each group; ties go to the smaller key. Null keys don't count."""
    n = rows.filter(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(key))).alias("_m")).select(*by, F.col(f"_m.{key}").alias(key), (-F.col("_m.n")).alias("n"))


def review_rows(records: DataFrame, rolls: DataFrame, stations: DataFrame, acs: DataFrame, low: float = 0.95) -> DataFrame:
    """Records that are invalid or of low confidence, with where they stand, the kind of issue, and the serial of the record they repeat.

    records (id, roll_id, station_id, serial, is_valid, duplicate_kind, duplicate_of_id, confidence), rolls (roll_id, year),
    stations (station_id, ac_id, part), acs (ac_id, ac_number). Names aren't carried. is_valid null is not invalid.
    """
    wanted = records.filter((F.col("is_valid") == F.lit(False)) | (F.col("confidence") < low))
    serials = records.select(F.col("id").alias("duplicate_of_id"), F.col("serial").alias("duplicate_serial"))
    issue = F.when(F.coalesce("duplicate_kind", F.lit("")) != "", "duplicate").when(~F.coalesce("is_valid", F.lit(False)), "validation").otherwise("low_confidence")
    out = wanted.join(rolls, "roll_id").join(stations, "station_id").join(acs, "ac_id").join(serials, "duplicate_of_id", "left")
    return out.select("ac_number", "part", "year", "id", "serial", issue.alias("issue"), "duplicate_serial", F.bround("confidence", 4).alias("confidence"))


def outcomes(rows: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    return rows.groupBy(*by, outcome).agg(F.count("*").alias("n"))


def outcome_lines(rows: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    """For each group one line: `n outcome`, most frequent first, then by name."""
    n = outcomes(rows, by, outcome)
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(outcome).alias("name")))), lambda x: F.concat((-x["k"]).cast("string"), F.lit(" "), x["name"]))
    return n.groupBy(*by).agg(F.array_join(listed, ", ").alias("line"))


def majority(tally: DataFrame, by: Sequence[str], seats: str = "seats") -> DataFrame:
    """Whether the largest has more than half of all: at least total // 2 + 1."""
    return tally.groupBy(*by).agg(F.sum(seats).alias("total"), F.max(seats).alias("top")).withColumn("has_majority", F.col("top") >= F.floor(F.col("total") / 2) + 1)


def preview(values: Column, most: int = 10) -> Column:
    """Struct of the first values in order, and how many more there are."""
    ordered = F.array_sort(values)
    return F.struct(F.slice(ordered, 1, most).alias("first"), F.greatest(F.size(ordered) - most, F.lit(0)).alias("more"))


def first_notes(*notes: Column, most: int = 4) -> Column:
    """The first notes that aren't null."""
    return F.slice(F.filter(F.array(*notes), lambda x: x.isNotNull()), 1, most)


def unpivoted(rows: DataFrame, keep: Sequence[str], cells: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """A row (label, state, detail) for each cell of a row, in one pass."""
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(k).alias("label"), s.cast("string").alias("state"), d.cast("string").alias("detail")) for i, (k, (s, d)) in enumerate(cells.items())])))


def held_or_gained(wins: DataFrame, group: Sequence[str], year: str, party: str) -> DataFrame:
    """wins with the party that won the election before, and hold or gain; a party under a later name holds. Null for the first election."""
    before = F.lag(party).over(Window.partitionBy(*group).orderBy(year))
    out = wins.withColumn("previous", before)
    return out.withColumn("outcome", F.when(F.col("previous").isNotNull(), F.when(same_party(F.col("previous"), F.col(party)), "hold").otherwise("gain")))


def lineage(rows: DataFrame, stations: DataFrame, current: str, historical: str, station: str = "station_id") -> DataFrame:
    """rows joined to the station they name: the current one, or where that is null the historical one."""
    s = stations.withColumnRenamed(station, "_station")
    return rows.withColumn("_station", F.coalesce(current, historical)).join(s, "_station").withColumnRenamed("_station", station)


def stamp(rows: DataFrame, by: Sequence[str], id_col: str) -> DataFrame:
    """(count, greatest id) of each group: what a cached result is kept under, so that new rows ask for another."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(id_col).alias("last_id"))
