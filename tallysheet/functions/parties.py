"""Party names: spellings of one party are one party, also under a later name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A party that goes on under later abbreviations.
RENAMED: dict[str, tuple[str, ...]] = {"TRS": ("BRS", "BHRS")}
NONE_OF_THE_ABOVE = "NOTA"


def party_key(x: Column) -> Column:
    """Trimmed, in upper case; null: empty."""
    return F.upper(F.trim(F.coalesce(x, F.lit(""))))


def same_party(a: Column, b: Column, renamed: Mapping[str, Sequence[str]] = RENAMED) -> Column:
    """Whether two names are one party. An old name and a later one are; two later ones of the same old name are not, unless equal."""
    x, y = party_key(a), party_key(b)
    out = x == y
    for old, later in renamed.items():
        out = out | ((x == old) & y.isin(*later)) | ((y == old) & x.isin(*later))
    return out


def party_name(x: Column, names: Mapping[str, str]) -> Column:
    """The full name of an abbreviation; an unknown one stays as it is, trimmed."""
    table = F.create_map(*[F.lit(v) for kv in names.items() for v in kv]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, party_key(x)), F.trim(F.coalesce(x, F.lit(""))))


def contests(party: Column) -> Column:
    """Whether a row is a candidate's: a null party and none of the above aren't, as `party <> 'NOTA'` has it in SQL."""
    return F.coalesce(party != NONE_OF_THE_ABOVE, F.lit(False))
