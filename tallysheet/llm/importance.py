"""Importance resampling: hashed n-gram models of target and raw text, and a sample drawn by Gumbel top-k."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallysheet.llm.common import staged
from tallysheet.llm.quality_rules import words

BUCKETS = 10_000


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """Hash buckets of a text's lower-cased words and word pairs."""
    w = words(F.lower(F.coalesce(text, F.lit(""))))
    return F.transform(F.array(w), lambda a: F.concat(F.transform(a, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")), F.transform(a, lambda x, i: F.pmod(F.xxhash64(x, F.get(a, i - 1)), F.lit(n)).cast("int"))))[0]


def feature_counts(rows: DataFrame, n: int, *flags: str) -> np.ndarray:
    """Counts of each bucket, for all rows and for those with each flag: at most n rows come to the driver, whatever the input."""
    got = rows.select(F.explode("_b").alias("b"), *flags).groupBy("b").agg(F.count("*").alias("raw"), *[F.count_if(F.col(f)).alias(f) for f in flags]).collect()
    out = np.zeros((1 + len(flags), n))
    for r in got:
        out[:, r["b"]] = [r["raw"], *[r[f] for f in flags]]
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), both smoothed by alpha."""
    p = np.log((target + alpha) / (target.sum() + alpha * len(target)))
    return p - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))


def gumbel(id_col: Column, seed: int) -> Column:
    """Gumbel noise from a hash of the id, so that a repeated run draws the same sample."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 512) -> tuple[float, int] | None:
    """(key, id) of the k-th row by key from the largest, then by id; None if no row is cut off.

    The range is narrowed by histograms of bins counts each, until few rows are left or all have one key.
    """
    n, lo, hi = keys.agg(F.count("*"), F.min("gumbel_key"), F.max("gumbel_key")).first()
    if k >= n:
        return None
    if k <= 0:
        return math.inf, 0
    left = k
    while n > 4 * bins and hi > lo:
        width = (hi - lo) / bins
        at = F.least(F.lit(bins - 1), F.floor((F.col("gumbel_key") - F.lit(lo)) / F.lit(width)).cast("int"))
        rows = keys.filter(F.col("gumbel_key").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if left <= r["n"]:
                n, lo, hi = r["n"], r["lo"], r["hi"]
                break
            left -= r["n"]
    rest = keys.filter(F.col("gumbel_key").between(lo, hi))
    if hi > lo:
        last = rest.orderBy(F.desc("gumbel_key"), "doc_id").limit(left).collect()[-1]
        return last["gumbel_key"], last["doc_id"]
    # One key for all that is left: the same search over ids.
    a, b = rest.agg(F.min("doc_id"), F.max("doc_id")).first()
    while a < b:
        mid = (a + b) // 2
        below = rest.filter(F.col("doc_id") <= mid).count()
        a, b = (a, mid) if below >= left else (mid + 1, b)
    return lo, a


def importance_resample(docs: DataFrame, target_ids: DataFrame, share: float | None = None, k: int | None = None, seed: int = 17, n_buckets: int = BUCKETS, temperature: float = 1.0, max_target: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: log_weight, gumbel_key (log_weight / temperature plus noise) and kept.

    target_ids has the ids of the target's documents in its first column; max_target of them at most, those of least
    hash, make the target's model, which is a bounded table for a broadcast. The raw model counts all of docs. The weight
    of a document is the ratio of the two hashed models of its words and word pairs. kept marks the k largest keys
    (or that share of the rows): a sample without replacement by weight. Ties go to smaller ids.

    A null or empty text has weight 0. With no target rows the ratio is to a flat model. Rows that repeat an id and a
    key stay or go together. A null id counts as the least. Other columns are left out. The models are n_buckets numbers each; the
    cut is found by histograms of the keys, so no task and no driver holds all keys. Scores are staged, so that the
    texts are read twice in all.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_target).withColumn("_target", F.lit(True))
    featured = docs.join(F.broadcast(ids), "doc_id", "left").select("_target", buckets(F.col("_text"), n_buckets).alias("_b"))
    raw, target = feature_counts(featured, n_buckets, "_target")
    table = F.from_json(F.lit("[" + ",".join(repr(round(float(x), 9)) for x in log_ratio(raw, target)) + "]"), "array<double>")
    scored = docs.select("doc_id", buckets(F.col("_text"), n_buckets).alias("_b"), table.alias("_w"))
    scored = scored.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.expr("aggregate(_b, 0D, (a, x) -> a + get(_w, x))").alias("log_weight"))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") / F.lit(float(temperature)) + gumbel(F.col("doc_id"), seed))
    scored, _ = staged(scored, "importance")
    if k is None:
        k = round((1.0 if share is None else share) * scored.count())
    cut = kth_largest(scored, k)
    if cut is None:
        kept = F.lit(True)
    else:
        kept = (F.col("gumbel_key") > F.lit(cut[0])) | ((F.col("gumbel_key") == F.lit(cut[0])) & (F.col("doc_id") <= F.lit(cut[1])))
    return scored.select(F.when(F.col("doc_id") != -(2**63), F.col("doc_id")).alias("doc_id"), "log_weight", "gumbel_key", kept.alias("kept"))
