"""Ratios that are safe on zero and null, change between counts, bounds, grouping of digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Margin bins in percent, [from, to).
MARGIN_BINS = ((0, 5), (5, 10), (10, 20), (20, 30), (30, 50), (50, 101))
DASH = "—"


def percent(n: Column, d: Column) -> Column:
    """100 n / d; null if n is null or d is null or 0."""
    return F.when(d.isNotNull() & (d != 0), n.cast("double") / d * 100)


def rate(n: Column, d: Column) -> Column:
    """100 n / d, and 0.0 where there is nothing to divide by."""
    return F.coalesce(percent(n, d), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def change(before: Column, after: Column) -> Column:
    """Struct of before, after, delta, delta_pct (2 decimals, half to even; null on a zero start) and available."""
    delta = after - before
    pct = F.when(before != 0, F.bround(delta.cast("decimal(38,6)") * 100 / before, 2).cast("double"))
    return F.struct(before.alias("before"), after.alias("after"), delta.alias("delta"), pct.alias("delta_pct"), (before.isNotNull() & after.isNotNull()).alias("available"))


def margin_bin(pct: Column) -> Column:
    """The label of the bin of a margin in percent; null outside all."""
    label = F.lit(None).cast("string")
    for lo, hi in reversed(MARGIN_BINS):
        label = F.when((pct >= lo) & (pct < hi), F.lit(f"{lo}%+" if hi > 100 else f"{lo}–{hi}%")).otherwise(label)
    return label


def indian_grouping(x: Column) -> Column:
    """12345678 -> 1,23,45,678; null -> a dash. The last three digits stand together, those before in pairs."""
    digits = F.abs(x.cast("decimal(38,0)")).cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d\d)+$)", ",")
    grouped = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))
    return F.coalesce(F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), grouped), F.lit(DASH))


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.coalesce(F.format_string(f"%.{digits}f%%", x.cast("double")), F.lit(DASH))


def pair_code(year: Column, number: Column) -> Column:
    """year * 1000 + number; see pair_year and pair_number."""
    return year * 1000 + number


def pair_year(code: Column) -> Column:
    return F.floor(code / 1000).cast("int")


def pair_number(code: Column) -> Column:
    return (code % 1000).cast("int")
