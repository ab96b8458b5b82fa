"""Vote arrays: sums, margins, ranks, and pairs by position."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    """Sum of an array of whole numbers; null elements count as 0, a null array stays null."""
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.cast("bigint"), F.lit(0)))


def descending(v: Column) -> Column:
    return F.sort_array(v, asc=False)


def margin(v: Column, valid: Column) -> Column:
    """Struct of the top two, their margin, margin_pct and leader_share of the valid total, and columns_with_votes; null with fewer than two columns.

    Shares are null where the valid total is null or 0. A margin of 0 is a margin.
    """
    s = descending(v)
    top, second = F.get(s, 0), F.get(s, 1)
    share = lambda x: F.when(valid != 0, x.cast("double") * 100 / valid)
    out = F.struct(top.alias("leader"), second.alias("runner_up"), (top - second).alias("margin"), share(top - second).alias("margin_pct"), share(top).alias("leader_share"), F.size(F.filter(v, lambda x: x > 0)).alias("columns_with_votes"))
    return F.when(F.size(v) >= 2, out)


def row_status(v: Column, valid: Column, columns: Column) -> Column:
    """not_backfilled without columns; check_failed if they don't add up to the printed total, or aren't as many as the sheet's usual number (where that is known); else ok."""
    bad_sum = valid.isNull() | (total(v) != valid)
    bad_size = columns.isNotNull() & (F.size(v) != columns)
    return F.when(v.isNull(), "not_backfilled").when(bad_sum | bad_size, "check_failed").otherwise("ok")


def ranked_name(names: Column, v: Column, rank: int) -> Column:
    """The name at a rank (0: leader); null if another column has as many votes, or names and columns differ in number."""
    value = F.get(descending(v), rank)
    hits = F.filter(F.arrays_zip(names.alias("name"), v.alias("v")), lambda x: x["v"] == value)
    return F.when((F.size(names) == F.size(v)) & (F.size(hits) == 1), F.get(hits, 0)["name"])


def named_columns(names: Column, v: Column, status: Column) -> Column:
    """Names and votes by position, only for verified rows with as many names as columns."""
    return F.when((status == "ok") & (F.size(names) == F.size(v)), F.arrays_zip(names.alias("name"), v.alias("votes")))


def reconciled(options: Column, others: int = 4, fewest: int = 5) -> Column:
    """The only combination of readings in which the candidates add up to valid, and valid, rejected and nota to total; null if there is none or more than one.

    options: an array of arrays of digit strings, one for each candidate, then valid, rejected, nota and total. Readings
    that aren't numbers are passed over, equal ones count once; with no reading left for a column, or fewer than `fewest` columns, there is no answer.
    Sums are built column by column, each with one way to it and whether there are more, so the work is columns times
    readings times different sums, not the product of all readings. An Arrow UDF, as a table of sums can't be folded by built-in functions.
    """

    @F.pandas_udf("array<bigint>")
    def only(column: pd.Series) -> pd.Series:
        return column.map(lambda o: None if o is None else only_way([None if x is None else list(x) for x in o], others, fewest))

    return only(options.cast("array<array<string>>"))


def only_way(options: list[list[str | None] | None], others: int, fewest: int) -> list[int] | None:
    read = [sorted({int(x) for x in o or () if x is not None and re.fullmatch(r"\s*[+-]?\d+\s*", x, re.ASCII)}) for o in options]
    if len(read) < max(fewest, others) or not all(read):
        return None
    columns, (valid, rejected, nota, totals) = read[:-others], read[-others:]
    if columns and min(o[0] for o in columns) >= 0:
        most = valid[-1]
    else:
        most = None  # a negative reading can bring a sum down again
    sums: dict[int, tuple[int, list[int]]] = {0: (1, [])}
    for o in columns:
        grown: dict[int, tuple[int, list[int]]] = {}
        for total, (ways, picks) in sums.items():
            for x in o:
                if most is None or total + x <= most:
                    before = grown.get(total + x)
                    grown[total + x] = (min(2, ways + before[0]), before[1]) if before else (ways, [*picks, x])
        sums = grown
    found = [(ways, [*picks, v, r, k, v + r + k]) for v in valid if v in sums for ways, picks in (sums[v],) for r in rejected for k in nota if v + r + k in totals]
    return found[0][1] if len(found) == 1 and found[0][0] == 1 else None
