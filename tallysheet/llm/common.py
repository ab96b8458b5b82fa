"""Helpers shared by the corpus operators: input columns, staged tables, word splitting."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of the input can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a new local one in local mode (tests); on a cluster that is an error, as executors have no local folder in common."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tallysheet-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet in the shared folder and read back: it survives lost executors, and later reads take only the columns they need.

    The driver's JVM then collects its garbage: Spark deletes the shuffle files of a finished job once its plan is gone, and
    a chain of jobs on a driver with memory to spare would else keep the files of all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.java.lang.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def released(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _LEFT.discard(path)


#: Staged tables that are still there. Results read them, so they stay until the application ends.
_LEFT: set[str] = set()


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        released(spark, *list(_LEFT))


#: Bits of a filter of ids, in words of 64.
FILTER_BITS = 1 << 23


def in_filter(rows: DataFrame, id_col: str, ids: DataFrame, ids_col: str, flag: str) -> DataFrame:
    """rows with a flag: false for rows whose id isn't in ids, true for the others and a few more. A broadcast of FILTER_BITS bits, whatever the number of ids; a full filter flags all."""
    word = lambda c: F.shiftright(F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)), 6).cast("int")
    bit = lambda c: F.expr(f"shiftleft(1L, cast(pmod(xxhash64({c}), {FILTER_BITS}) % 64 as int))")
    field = ids.groupBy(word(ids_col).alias("_gone_word")).agg(F.bit_or(bit(f"`{ids_col}`")).alias("_gone_bits"))
    met = rows.join(F.broadcast(field), word(id_col) == F.col("_gone_word"), "left")
    return met.withColumn(flag, F.coalesce(F.col("_gone_bits").bitwiseAND(bit(f"`{id_col}`")) != 0, F.lit(False))).drop("_gone_word", "_gone_bits")


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8 with A-Z lower-cased. (bytes.lower and bytes.split know ASCII only.)"""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def record_batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def in_slices(values: list, sizes: list[int], most: int):
    """(from, to) ranges of consecutive values whose sizes add up to most, or one value that alone is larger."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


_KEPT: dict[str, object] = {}


def kept_by_worker(name: str, make=lambda: None):
    """What a Python worker keeps from task to task for one operator. What it kept for another operator goes, so that a chain of operators needs no more memory than the largest."""
    if name not in _KEPT:
        _KEPT.clear()
        _trim()
        _KEPT[name] = make()
    return _KEPT[name]


def _trim() -> None:
    """Gives memory that the last operator used back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
