"""Event streams: windowed counts under a watermark, and a ledger kept up to date batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysheet.operators.store import upsert

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files; ts is cast, as watermarks need timestamps with a zone."""
    return spark.readStream.schema(EVENTS).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and value sums by window and type; runs on a stream or a table. With slide, a window begins so often and an event is in several."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(by, start, end, n): runs of events with less than the gap between; end is the last event's time and the gap. On a stream a session comes out once the watermark has passed its end."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def keep_ledger(events: DataFrame, path: str, checkpoint: str, key: tuple[str, ...] = ("user_id", "event_type")):
    """A query that keeps the latest entry of each key: every batch is merged into two folders by turns, so that a batch that runs again gives the same state."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*key).agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r")).select(*key, "r.*")
        before, after = f"{path}/{(number + 1) % 2}", f"{path}/{number % 2}"
        if number > 0:
            old = spark.read.parquet(before)
            newer = old.unionByName(new).groupBy(*key).agg(F.max_by(F.struct("ts", "event_id", "value"), F.struct("ts", "event_id")).alias("r")).select(*key, "r.*")
            new = upsert(old, newer, list(key))
        new.write.mode("overwrite").parquet(after)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
