"""From raw documents to packed sequences: language, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.llm.common import documents, staged
from tallysheet.llm.jaccard import jaccard_join
from tallysheet.llm.langid import UNKNOWN, identify
from tallysheet.llm.packing import pack
from tallysheet.llm.pii import key_of, pseudonymise
from tallysheet.llm.spans import drop_repeats
from tallysheet.session import ship


def _as_documents(new: DataFrame, docs: DataFrame) -> DataFrame:
    out = new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else new
    return out.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with a probability of 0.5 or more; the model is of the labelled ones of docs."""
    ship(spark)
    found = identify(docs.withColumnRenamed("lang", "_label"), docs, lang_col="lang")
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= 0.5)).withColumnRenamed("_label", "lang").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group that links of similarity 0.8 (five-word shingles) connect."""
    ship(spark)
    groups = jaccard_join(docs, size=5, num=80, den=100)
    return docs.join(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes runs of sentences that stood in an earlier document or place; every document stays."""
    ship(spark)
    return _as_documents(drop_repeats(docs), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces private values by pseudonyms of their format; every document stays."""
    ship(spark)
    return _as_documents(pseudonymise(docs, key_of(spark)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a packed sequence, see pack."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("packing", packing),
]

#: Models, components and tokenisation have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
