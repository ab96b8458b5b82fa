"""Devanagari from fonts with an encoding or an order of their own: glyphs replaced, signs put where Unicode has them. All in the JVM.

A font's table is a parameter; `text.decoder` is for tables whose keys have several characters.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.functions.text import clean_share, legacy_font, squeezed

# Letters and signs, and the glyphs of one font in visual order.
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहक़ख़ग़ज़ड़ढ़फ़य़"
VIRAMA, NUKTA, SHORT_I, REPH = "्", "़", "ि", "र्"
SIGNS = "ा-ौंःँ"
VISUAL_GLYPHS = {"à": "म्", "¢": "क्ष", "Û": "न्", "ȣ": "ी", "Þ": "ब्", "è": "स्", "Ö": "ण्", "È": "क्", "Ē": "ग्र", "Ħ": "ब्र", "Ù": "त्त"}
VISUAL_SHORT_I = "ͪͧǒǑǓ"
VISUAL_LIGATURE = ("घालय", "द्यालय")
VISUAL_REPH = r"\["
UNDECODED = r"[A-Za-z@#$^*\\]"

CLUSTER = f"(?:[{CONSONANTS}]{VIRAMA})*[{CONSONANTS}]"


def with_glyphs(x: Column, glyphs: Mapping[str, str]) -> Column:
    """Each glyph (one character, in no other's replacement) replaced."""
    held = set("".join(glyphs.values()))
    if any(len(k) != 1 or k in held for k in glyphs):
        raise ValueError("glyphs are single characters, and none stands in a replacement; see text.decoder for others")
    for k, v in glyphs.items():
        x = F.replace(x, F.lit(k), F.lit(v))
    return x


def short_i_after(x: Column) -> Column:
    """A short i that stands before its consonants goes behind them."""
    return F.regexp_replace(x, f"{SHORT_I}({CLUSTER})", f"$1{SHORT_I}")


def reph_before(x: Column) -> Column:
    """A reph that stands behind a consonant and its vowel signs goes before them. One pass, so one that is in place stays."""
    return F.regexp_replace(x, f"([{CONSONANTS}])([{SIGNS}]*){REPH}", f"{REPH}$1$2")


def repaired(x: Column, glyphs: Mapping[str, str], strays: str) -> Column:
    """Text of a font whose glyphs are mapped to wrong characters: glyphs, order, strays (a regular expression) removed, the word NULL and extra white space removed. Null: empty."""
    t = reph_before(short_i_after(with_glyphs(F.coalesce(x, F.lit("")), glyphs)))
    return squeezed(F.regexp_replace(F.regexp_replace(t, strays, ""), r"\bNULL\b", " "))


def visual_repaired(x: Column) -> Column:
    """Text of the font in visual order: its glyphs, a short i before its consonants (a space may be between), and a reph, printed as [, after them."""
    cluster = f"(?:[{CONSONANTS}]{VIRAMA})*[{CONSONANTS}]{NUKTA}?"
    t = F.replace(with_glyphs(x, VISUAL_GLYPHS), *map(F.lit, VISUAL_LIGATURE))
    t = F.regexp_replace(t, f"[{VISUAL_SHORT_I}]", SHORT_I)
    t = F.regexp_replace(t, rf"{SHORT_I}\s*({cluster})", f"$1{SHORT_I}")
    return F.regexp_replace(t, f"({cluster}){VISUAL_REPH}", f"{REPH}$1")


def decoded_share(x: Column, strays: str = UNDECODED) -> Column:
    """1 less the share of characters that weren't decoded; 0.0 for empty text."""
    return F.when(F.coalesce(F.trim(x), F.lit("")) == "", F.lit(0.0)).otherwise(clean_share(x, strays))


def converted(raw: Column, decode) -> Column:
    """Struct of text, raw and confidence of a cell. Devanagari, and cells without ASCII letters, stay as they are unless they look like a legacy font; others are decoded. A blank cell: nulls and 1.0."""
    cell = squeezed(raw)
    plain = (cell.rlike(r"[\x{0900}-\x{097F}]") | ~cell.rlike("[A-Za-z]")) & ~legacy_font(cell)
    out = decode(cell)
    text = F.when(plain, cell).otherwise(F.nullif(out, F.lit("")))
    sure = F.when(plain, F.lit(1.0)).otherwise(decoded_share(out))
    blank = F.coalesce(cell, F.lit("")) == ""
    return F.struct(F.when(~blank, text).alias("text"), F.when(~blank, cell).alias("raw"), F.when(blank, 1.0).otherwise(sure).alias("confidence"))


def font_of(pages: DataFrame, by: list[str], text: str, signs: Mapping[str, str]) -> DataFrame:
    """The font of each document: the one with most characters of its own; ties go to the first named. signs: the characters of each font."""
    count = lambda s: F.coalesce(F.sum(F.regexp_count(F.col(text), F.lit(f"[{re.escape(s)}]"))), F.lit(0))
    n = pages.groupBy(*by).agg(F.array(*[count(s) for s in signs.values()]).alias("counts"))
    return n.withColumn("font", F.get(F.array(*map(F.lit, signs)), (F.array_position("counts", F.array_max("counts")) - 1).cast("int")))
