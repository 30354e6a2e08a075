"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-folioworks-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioworks/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside goes to Python at most ``BATCH_ROWS`` whole files at once, unless the session has its own limit."""
    unset = spark.conf.get(BATCH_SETTING) == "10000"
    if unset:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(BATCH_SETTING)


def rebuild(df: DataFrame, path: str) -> None:
    """Truncate and rebuild a derived table. ``path`` must not be read by ``df``."""
    df.write.mode("overwrite").parquet(path)
