"""Streaming jobs: incremental ingest, silent keys, live status counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.keyed import KeyedTable
from .state import changed_files, rocks_state


def ingest(stream: DataFrame, index: Callable[..., DataFrame], target: str, checkpoint: str) -> None:
    """Index what is new in ``stream`` and append it to ``target``; returns when all there is is done.

    Batches are written under their number, so a batch that runs again
    replaces itself.  ``index`` gets as ``stored`` what the batches before wrote,
    so that what several bring is indexed once.  Deletions need a snapshot and
    ``reconcile``.
    """

    def write(batch: DataFrame, number: int) -> None:
        stored = batch.sparkSession.read.parquet(target).filter(F.col("batch") < number) if number else None
        index(batch, stored=stored).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def follow_files(scans: DataFrame, table: KeyedTable, checkpoint: str, wait: bool = True) -> None:
    """Keep ``table(location_id, relative_path, scan_at, size, mtime, sha256)`` at what the stream's last scan saw.

    Only buckets with changed files are written; a batch that runs again leaves the same table.
    """

    def write(batch: DataFrame, _: int) -> None:
        table.change(batch.withColumn("gone", F.col("kind") == "gone").drop("kind"), deleted="gone")

    with rocks_state(scans.sparkSession):
        running = changed_files(scans).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if wait:
            running.awaitTermination()


def silent_keys(events: DataFrame, lease: str, watermark: str = "10 minutes") -> DataFrame:
    """Sessions of each job that a silence longer than ``lease`` ends: ``job_id, started, expired_at, beats``."""
    own = events.withWatermark("ts", watermark).groupBy(F.session_window("ts", lease), "job_id").agg(F.count(F.lit(1)).alias("beats"))
    return own.select("job_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expired_at"), "beats")


def status_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Events by window and status; rows later than the watermark are dropped by the stream."""
    own = events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "status").agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("window.start").alias("started"), "status", "n")
