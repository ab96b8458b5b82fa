"""Queries over the driver's tables, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.bpe_corpus import encode_corpus
from tallysheet.llm.brown import score_corpus
from tallysheet.llm.common import documents
from tallysheet.llm.importance import importance_resample
from tallysheet.llm.jaccard import jaccard_join
from tallysheet.llm.langid import identify
from tallysheet.llm.media import media_columns
from tallysheet.llm.packing import pack
from tallysheet.llm.pii import key_of, pseudonymise
from tallysheet.llm.quality_rules import quality_rules
from tallysheet.llm.spans import drop_repeats


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a WAV file in a column, with its fingerprint."""
    return media_columns(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    return quality_rules(documents(spark, sf_dir))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target: labelled documents of good quality that aren't toxic. The sample has their share of the labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    share = labels.agg(F.avg(F.when(good, 1.0).otherwise(0.0))).first()[0]
    return importance_resample(documents(spark, sf_dir), labels.filter(good).select("doc_id"), share=1.0 if share is None else share)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids."""
    return pack(documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the session's setting, see key_of."""
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key_of(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 4 isn't 2; a null id counts as the empty string."""
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out).select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them."""
    return encode_corpus(documents(spark, sf_dir), outputs=False).drop("ids", "decoded")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9 or more."""
    return jaccard_join(documents(spark, sf_dir), size=3, num=90, den=100)


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod 7 isn't 2."""
    return score_corpus(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three sentences and 25 words or more; a row for each document, with what is left of its text."""
    return drop_repeats(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "text", "n_removed")


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT doc_id, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS g, i
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY doc_id),
raw_lines AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM t),
lines AS (SELECT doc_id, host, line, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
          FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
norm AS (SELECT doc_id, host, array_to_string(lw, ' ') AS line, len(lw) AS n FROM lines),
hosts AS (SELECT host, count(DISTINCT doc_id) AS host_docs FROM t GROUP BY host),
frequent AS (SELECT host, line FROM norm JOIN hosts USING (host) GROUP BY host, line, host_docs
             HAVING count(DISTINCT doc_id) > 10 AND (count(DISTINCT doc_id) > 0.02::DOUBLE * host_docs OR count(DISTINCT doc_id) > 1000)),
gone AS (SELECT doc_id, sum(n) AS n, count(*) AS k FROM norm JOIN frequent USING (host, line) GROUP BY doc_id),
base AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
                (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
                coalesce(gone.n, 0)::BIGINT AS removed_words, coalesce(gone.k, 0)::BIGINT AS removed_lines
         FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 50 AND removed_words <= 0.5 * n_words AS kept, removed_words, removed_lines
FROM failed
"""

QUERIES = {f.__name__: f for f in (op1_media_columns, op2_quality_rules, op3_importance_resampling, op4_packing, op5_pii, op6_language_id, op7_bpe_encoding, op8_ngram_jaccard_join, op9_brown_lm, op10_substring_dedup)}

SQL = {"op2_quality_rules": OP2_SQL}
