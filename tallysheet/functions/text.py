"""Text: normalisation, place names, codes and labels, numbers in text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digits, letters and words that results depend on.
DEVANAGARI_DIGITS = "०१२३४५६७८९"
DROPPED_MARKS = "‍‌़ँंॅ"
FOLDED_FROM = "ूीैौणॉ"
FOLDED_TO = "ुिेोना"
VOWEL_SIGNS = "ािीुूेैोौ"
PLACE_STOP_WORDS = ("गांव", "गाँव", "ग्राम", "आंशिक")
BUILDING_STOP_WORDS = ("राजकीय", "प्राथमिक", "विद्यालय", "इंटर", "इण्टर", "कालेज", "कॉलेज", "काॅलेज", "स्कूल", "भवन", "रोड", "पब्लिक", "जूनियर", "हाईस्कूल", "उच्चतर", "माध्यमिक", "सेवा", "केन्द", "केन्द्र", "पो", "ओ", "तहसील", "जिला", "पिन", "कोड", "देहरादून", "कक्ष", "संख्या", "गांव", "ग्राम")
ROOM = r"क\s*[\.\-0]?\s*न\s*[\.\-0ं]*\s*-?\s*([0-9०-९])"
ID_MODERN = r"^[A-Z]{3}\d{7}$"
ID_LEGACY = r"^[A-Z]{2}[\\/]\d+[\\/]\d+[\\/]\d+$"
GENDERS = {"M": ("M", "पु"), "F": ("F", "W", "मह", "स्त्"), "O": ("O", "T", "अन")}
AGES = (18, 120)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in function; for text that isn't composed already."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def ascii_digits(x: Column) -> Column:
    return F.translate(x, DEVANAGARI_DIGITS, "0123456789")


def normalise(x: Column) -> Column:
    """A place name for comparison: marks dropped, spellings folded, digits and punctuation to spaces, lower case. Null: empty. Text must be composed (see nfc)."""
    t = F.translate(F.translate(_blank(x), DROPPED_MARKS, ""), FOLDED_FROM, FOLDED_TO)
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(t, r"[0-9०-९\-\.,()/:;।\[\]]+", " "), r"\s+", " ")))


def stem(word: Column) -> Column:
    """Without vowel signs at the end."""
    return F.regexp_replace(word, f"[{VOWEL_SIGNS}]+$", "")


def _stop(words: tuple[str, ...]) -> list[str]:
    """The stop words as normalise and stem leave them."""
    out = set()
    for w in words:
        t = unicodedata.normalize("NFC", w)
        t = "".join(c for c in t if c not in DROPPED_MARKS).translate(str.maketrans(FOLDED_FROM, FOLDED_TO))
        out.add(t.lower().rstrip(VOWEL_SIGNS))
    return sorted(out)


def _tokens(x: Column, shortest: int, stop: list[str]) -> Column:
    words = F.transform(F.split(normalise(x), " "), stem)
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~w.isin(stop) if stop else F.length(w) >= shortest)


def place_tokens(place: Column) -> Column:
    return _tokens(place, 2, _stop(PLACE_STOP_WORDS))


def unspaced(x: Column) -> Column:
    """The text that words are looked for in: normalised, without spaces."""
    return F.replace(normalise(x), F.lit(" "), F.lit(""))


def _found(words: Column, hay: Column) -> Column:
    return F.size(F.filter(words, lambda w: hay.contains(w)))


def place_within(tokens: Column, hay: Column) -> Column:
    """See place_found_in; tokens of place_tokens, hay of unspaced."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda w: hay.contains(w))


def place_found_in(place: Column, text: Column) -> Column:
    """Every token of the place stands in the text, spaces aside; false without tokens."""
    return place_within(place_tokens(place), unspaced(text))


def _no_brackets(x: Column) -> Column:
    return F.regexp_replace(_blank(x), r"(?s)\(.*", " ")


def _letters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))


def building_tokens(building: Column) -> Column:
    """The building's distinctive tokens."""
    return _tokens(_no_brackets(building), 3, _stop(BUILDING_STOP_WORDS))


def building_within(tokens: Column, hay: Column, share: float = 0.75) -> Column:
    """See building_matches; tokens of building_tokens, hay of unspaced."""
    return F.when(_letters(tokens) >= 5, _found(tokens, hay) >= share * F.size(tokens))


def building_matches(building: Column, text: Column, share: float = 0.75) -> Column:
    """That share of the building's distinctive tokens stands in the text; null if they have fewer than five letters."""
    return building_within(building_tokens(building), unspaced(text), share)


def building_phrase(building: Column) -> Column:
    """The building's place phrase between spaces; null if it has fewer than four letters."""
    stop = _stop(BUILDING_STOP_WORDS)
    kept = [w for w in stop if w not in _stop(("गांव", "ग्राम"))]
    words = F.filter(F.split(normalise(_no_brackets(building)), " "), lambda w: ~stem(w).isin(kept) & (w != ""))
    return F.when(_letters(words) >= 4, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


def whole_words(name: Column) -> Column:
    """The name that a phrase is looked for in: normalised, between spaces."""
    return F.concat(F.lit(" "), normalise(name), F.lit(" "))


def building_phrase_in(building: Column, name: Column) -> Column:
    """The building's place phrase stands in the name as whole words; null if it has fewer than four letters."""
    return whole_words(name).contains(building_phrase(building))


def overlap_words(src: Column) -> Column:
    """The distinct words of three letters and more."""
    return F.array_distinct(_tokens(_no_brackets(src), 3, []))


def words_overlap(words: Column, hay: Column) -> Column:
    """See text_overlap; words of overlap_words, hay of unspaced."""
    return F.when(F.size(words) > 0, _found(words, hay) / F.size(words)).otherwise(0.0)


def text_overlap(src: Column, dst: Column) -> Column:
    """Share of the distinct words of src (three letters and more) that stand in dst; 0 without words."""
    return words_overlap(overlap_words(src), unspaced(dst))


def room_number(x: Column) -> Column:
    return F.nullif(ascii_digits(F.regexp_extract(_blank(x), ROOM, 1)), F.lit(""))


def name_key(x: Column) -> Column:
    """A name for comparison: without white space and joiners, in lower case; null: empty."""
    return F.lower(F.regexp_replace(_blank(x), "[\\s ​-‍]+", ""))


def gender(x: Column) -> Column:
    v = F.upper(F.trim(x))
    out = F.when(v.isin("M", "F", "O", "UNKNOWN"), v)
    for code, starts in GENDERS.items():
        for s in starts:
            out = out.when(v.startswith(s), code)
    return out.otherwise("UNKNOWN")


def plausible_age(x: Column) -> Column:
    age = F.trim(x.cast("string")).try_cast("int")
    return F.when(age.between(*AGES), age)


def id_format(x: Column) -> Column:
    v = F.upper(F.trim(_blank(x)))
    return v.rlike(ID_MODERN) | v.rlike(ID_LEGACY)


def first_int(x: Column) -> Column:
    return F.nullif(F.regexp_extract(ascii_digits(_blank(x)), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def leading_int(x: Column) -> Column:
    return F.nullif(F.regexp_extract(ascii_digits(_blank(x)), r"^\s*(\d+)", 1), F.lit("")).try_cast("bigint")


def whole_number(x: Column) -> Column:
    """A cell as a whole number, thousands commas aside; null if it isn't one."""
    return F.regexp_replace(F.trim(x.cast("string")), ",", "").try_cast("bigint")


def seen_digits(x: Column) -> Column:
    """Readings of digits: letters that look like a zero are one, all but digits goes."""
    return F.regexp_replace(F.translate(ascii_digits(_blank(x)), "oO。○°DQ〇", "00000000"), r"[^0-9]", "")


def trimmed_readings(readings: Column) -> Column:
    """The readings, and for those of three digits or more also without the first or the last digit; distinct."""
    return F.array_distinct(F.flatten(F.transform(readings, lambda r: F.when(F.length(r) >= 3, F.array(r, F.substring(r, F.lit(2), F.length(r)), F.substring(r, F.lit(1), F.length(r) - 1))).otherwise(F.array(r)))))


def label_number(x: Column) -> Column:
    """Struct of number and suffix of a label such as 12A or 12-A; null if it isn't one."""
    form = r"^(\d{1,4})-?([A-E])?$"
    return F.when(x.rlike(form), F.struct(F.regexp_extract(x, form, 1).cast("int").alias("number"), F.regexp_extract(x, form, 2).alias("suffix")))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_blank(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def null_if_blank(x: Column, blanks: tuple[str, ...] = ("", "null", "none", "nan", "na", "n/a", "-")) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*blanks), F.trim(x))


def first_label(*parts: Column) -> Column:
    """The first of the parts that isn't null or empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def joined(*parts: Column, by: str = " ") -> Column:
    """Parts that aren't null or empty; null if none is left."""
    return F.nullif(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), by), F.lit(""))


def code_label(code: Column, labels: dict[str, str], default: str) -> Column:
    """The label of a code; an unknown code stands for itself, null and empty for the default."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    known = F.try_element_at(F.create_map(*pairs), code) if pairs else F.lit(None).cast("string")
    return F.coalesce(known, F.nullif(code, F.lit("")), F.lit(default))


def canonical(x: Column, aliases: dict[str, str]) -> Column:
    """A name or the one that it is an alias of."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv]), x), x) if aliases else x


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def legacy_font(x: Column, share: float = 0.55, fewest: int = 20) -> Column:
    """Text in a font of its own encoding: twenty characters and more (white space aside), that share of them ASCII letters, at most a fifth Devanagari."""
    t = F.regexp_replace(x, r"\s+", "")
    n = F.length(t)
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    native = F.length(F.regexp_replace(t, r"[^\x{0900}-\x{097F}]", ""))
    return F.coalesce((n >= fewest) & (letters >= share * n) & (native <= 0.2 * n), F.lit(False))


def decoder(table: dict[str, str], reorder: tuple[tuple[str, str], ...] = ()):
    """A pandas UDF that decodes a legacy font: the longest key of table at each place, then regular expressions in order."""
    import re

    longest = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True)))) if table else None
    steps = [(re.compile(a), b) for a, b in reorder]

    @F.pandas_udf(StringType())
    def decode(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            if x is None:
                return None
            y = longest.sub(lambda m: table[m[0]], x) if longest else x
            for pattern, to in steps:
                y = pattern.sub(to, y)
            return y

        return s.map(one)

    return decode


def clean_share(x: Column, stray: str) -> Column:
    """1 less the share of stray characters (a regular expression), from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.regexp_count(x, F.lit(stray)) / F.greatest(F.length(x), F.lit(1))))


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros; a wider one stays whole."""
    return F.format_string(f"%0{width}d", n.cast("long"))


def percent_encoded_path(*parts: Column) -> Column:
    return F.concat_ws("/", *[F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts])
