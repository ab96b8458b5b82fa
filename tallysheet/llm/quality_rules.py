"""Quality rules from words and from the frequency of lines across the documents of a host; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.common import SPACES, columns

SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def windows(w: str) -> Column:
    """64-bit hashes of the 3-word windows of the array column w."""
    hashes = f"if(size({w}) < 3, array(), transform(sequence(0, size({w}) - 3), i -> xxhash64(get({w}, i), get({w}, i + 1), get({w}, i + 2))))"
    return F.expr(hashes)


def covered(h: str) -> Column:
    """From the window hashes: the words covered by those that aren't unique (first ones included).

    Only arrays with a repeated window are sorted; no window is compared with all others.
    """
    pairs = f"array_sort(transform({h}, (x, i) -> struct(x as h, i as at)))"
    # A window repeats if a neighbour in order has its hash. One fold over the sorted pairs collects positions, one over the positions counts.
    marked = f"transform(array({pairs}), s -> array_sort(transform(filter(transform(s, (x, i) -> struct(x.at as at, x.h = get(s, i - 1).h as before, x.h = get(s, i + 1).h as after)), y -> coalesce(y.before, false) or coalesce(y.after, false)), y -> y.at)))[0]"
    total = f"aggregate({marked}, struct(0L as n, -3 as last), (a, x) -> struct(a.n + least(3, x - a.last) as n, x as last), a -> a.n)"
    return F.expr(f"case when size(array_distinct({h})) = size({h}) then 0L else {total} end")


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, t.alias("_t")).select(*keep, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    out = out.withColumn("_h", windows("_w"))
    n_words = F.size("_w").cast("long")
    out = out.select(
        *keep,
        n_words.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered("_h").cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def line_rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each line with a word: host, document, position, hash of the normalised line (lower case, single spaces), words."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("_t"))
    rows = rows.select("doc_id", "host", F.xxhash64("_t").alias("text_hash"), F.posexplode(F.split("_t", "\n", -1)).alias("pos", "_line"))
    rows = rows.filter(F.col("_line").rlike(r"[^\x20\x09-\x0D]")).withColumn("_n", F.array_join(words(F.lower("_line")), " "))
    return rows.select("doc_id", "host", "text_hash", "pos", F.xxhash64("_n").alias("line"), (F.length("_n") - F.length(F.replace("_n", F.lit(" "), F.lit(""))) + 1).alias("line_words"))


def boilerplate(lines: DataFrame, docs: DataFrame, id_col: str, host_col: str, min_docs: int, most_docs: int, host_share: float, salts: int) -> DataFrame:
    """(host, line) that stand in more than min_docs documents, and in more than host_share of the host's documents or more than most_docs. Hosts meet their lines by host and a salt of the line."""
    counted = lines.groupBy("host", "line").agg(F.countDistinct("doc_id").alias("n_docs")).filter(F.col("n_docs") > min_docs).withColumn("salt", F.pmod("line", F.lit(salts)))
    hosts = docs.groupBy(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host")).agg(F.countDistinct(F.col(id_col)).alias("host_docs"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return counted.join(hosts, ["host", "salt"]).filter((F.col("n_docs") > host_share * F.col("host_docs")) | (F.col("n_docs") > most_docs)).select("host", "line")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = 10, most_docs: int = 1000, host_share: float = 0.02, max_removed: float = 0.5, min_left: int = 50, salts: int = 16) -> DataFrame:
    """One row for each row of docs: base measures, base_failed, words in removed lines, and whether the document is kept.

    Lines are normalised (lower case, single spaces) and hashed; a line is removed where it stands in more than
    min_docs distinct documents of its host, and in more than host_share of them or in more than most_docs (a line of a
    very large host). A document is kept if it doesn't fail the base rules, at least min_left words are left, and no more than
    max_removed of its words are in removed lines.

    A null text has no words and fails. A null host is a host of its own, the empty one. Rows that repeat an id count
    once for a line's frequency, and each gets its own verdict. An empty table gives none. Other columns are left out.

    Shuffles carry hashes, not texts. Counts are combined before each shuffle; lines are joined to the frequent ones by
    host, hash and a salt, so that a line that a third of all documents share is dealt over many tasks.
    """
    docs = columns(docs, *dict.fromkeys([id_col, text_col, host_col]))
    lines = line_rows(docs, id_col, text_col, host_col)
    frequent = boilerplate(lines, docs, id_col, host_col, min_docs, most_docs, host_share, salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = lines.withColumn("salt", F.pmod(F.hash("doc_id", "pos"), F.lit(salts)))
    removed = salted.join(frequent, ["host", "line", "salt"]).groupBy("doc_id", "host", "text_hash", "pos").agg(F.max("line_words").alias("n"))
    removed = removed.groupBy("doc_id", "host", "text_hash").agg(F.sum("n").alias("removed_words"), F.count("*").alias("removed_lines"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("_text"))
    base = base_measures(base, "_text")
    at = [base[c].eqNullSafe(removed[c]) if c == "doc_id" else base[c] == removed[c] for c in ("doc_id", "host", "text_hash")]
    out = base.join(removed, at, "left").select(base["*"], F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"))
    left = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (left >= min_left) & (F.col("removed_words") <= max_removed * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed_words", "removed_lines")
