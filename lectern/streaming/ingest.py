"""Incremental ingest: the latest state of each key from a stream of versions, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_versions(versions: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """(key, at, values) of the newest version of every key, batch or streaming (complete or update mode).

    Of versions at one time the greatest values count. The state holds one row a key.
    """
    newest = F.max(F.struct(at, *values)).alias("v")
    return versions.where(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, "v.*")


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n): events by tumbling window; a window's state goes when the watermark, late behind the newest event, passes it."""
    stream = events.withWatermark(at, late) if events.isStreaming else events
    return stream.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def publish_batches(stream: DataFrame, target: str, checkpoint: str, key: str = "key"):
    """Append each micro-batch under target once: a batch that is run again overwrites its own folder.

    Rows that repeat a key within a batch are one row. Read the folder's batches with latest_versions().
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
