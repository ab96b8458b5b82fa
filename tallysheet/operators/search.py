"""Ranked search over names and numbers, and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import ascii_digits

NUMBER_QUERY = r"(?i)^\s*(?:part|booth|station)\s*(?:no\.?|number)?\s*(\d+)\s*$"


def hits(rows: DataFrame, kind: str, query: str, names: Sequence[str], number: str | None, label: Column, featured: Column | None = None) -> DataFrame:
    """(kind, label, rank) of rows with a name like %query% (case aside; % and _ act as wildcards) or with the number that the query is."""
    pattern = f"%{query.strip()}%"
    cond = F.lit(False)
    for n in names:
        cond = cond | F.coalesce(F.col(n).ilike(pattern), F.lit(False))
    if number is not None and query.strip().isdigit():
        cond = cond | (F.col(number) == int(query))
    rank = F.when(featured if featured is not None else F.lit(False), 0).otherwise(1)
    return rows.filter(cond if query.strip() else F.lit(False)).select(F.lit(kind).alias("kind"), label.alias("label"), rank.alias("hit_rank"))


def top(found: Sequence[DataFrame], limit: int = 60) -> DataFrame:
    """The first hits by rank, then by kind in the order given, then by label."""
    out = None
    for i, f in enumerate(found):
        f = f.withColumn("kind_no", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.orderBy("hit_rank", "kind_no", "label").limit(limit)


def numbered_query(query: Column) -> Column:
    """The number of a query such as `Part 141` or `booth no. 10`; null if it is another."""
    return F.nullif(F.regexp_extract(ascii_digits(query), NUMBER_QUERY, 1), F.lit("")).try_cast("int")


def page(rows: DataFrame, order: Sequence[str | Column], number: int, size: int) -> DataFrame:
    """A page of rows; number is at least 1, size from 10 to 500."""
    number, size = max(1, number), min(500, max(10, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def pages(rows: DataFrame, size: int) -> DataFrame:
    size = min(500, max(10, size))
    return rows.agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / size).alias("n_pages"))


def facets(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def matches(blob: Sequence[str], query: str, tokens: Column | None = None, token: str | None = None) -> Column:
    """The query stands in the lower-cased columns together, and the token is one of the space-separated tokens."""
    cond = F.lower(F.concat_ws(" ", *blob)).contains(query.lower())
    return cond & F.array_contains(F.split(tokens, " "), token) if token and tokens is not None else cond
