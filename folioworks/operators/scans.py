"""Prefix scans by key whose keys may be larger than a task.

Rows are dealt to ranges of ``(key, order)``, so a large key lies in several of
them; every range is scanned for itself, and what a range needs of the ranges
before it is added from sums by range.  Only keys that cross a border have such
sums, at most two rows a border: that table is small whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.work import work_path


def in_ranges(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``part``, the number of their range; written, so that it stays the same."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_path(spark, "ranges")
    dealt = rows.repartitionByRange(n, *key, *order) if key or order else rows
    dealt.withColumn("part", F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def local(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy("part", *key).orderBy(*order)


def with_carry(rows: DataFrame, carry: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` joined to what ranges before theirs bring; ``carry`` has a row for each range of a key that crosses a border."""
    if not key:
        return rows.join(F.broadcast(carry), "part", "left")
    same = rows["part"] == carry["_part"]
    for k in key:
        same = same & rows[k].eqNullSafe(carry[f"_{k}"])
    return rows.join(F.broadcast(carry), same, "left").drop("_part", *[f"_{k}" for k in key])


def carried(sums: DataFrame, key: list[str], **columns: Column) -> DataFrame:
    """The carry table of ``with_carry`` from sums by range: the named columns over the ranges of a key in turn."""
    several = sums.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("_ranges > 1")
    out = several.select(F.col("part").alias("_part"), *[F.col(k).alias(f"_{k}") for k in key], *[c.alias(name) for name, c in columns.items()])
    return out if key else out.withColumnRenamed("_part", "part")


def turns(key: list[str]) -> WindowSpec:
    """The ranges of a key before a range."""
    return Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` with numbers from 1 without gaps in each key, by ``order``, and ``<out>_of``, the rows of the key."""
    own = in_ranges(rows, key, order)
    sums = own.groupBy("part", *key).agg(F.count(F.lit(1)).alias("n"))
    before = carried(sums, key, _before=F.coalesce(F.sum("n").over(turns(key)), F.lit(0)), _all=F.sum("n").over(Window.partitionBy(*key)))
    here = own.withColumns({out: F.row_number().over(local(key, order)), "_here": F.count(F.lit(1)).over(Window.partitionBy("part", *key))})
    here = with_carry(here, before, key)
    number = (F.col(out) + F.coalesce("_before", F.lit(0))).cast("long")
    return here.withColumns({out: number, f"{out}_of": F.coalesce("_all", "_here")}).drop("part", "_before", "_all", "_here")


def progress(rows: DataFrame, key: list[str], order: list[str], phase: str, current: str, total: str) -> DataFrame:
    """``rows`` with ``run``, the number of their stretch of one phase, ``shown``, the largest ``current`` of the run so far, and ``shown_total``, the largest total (at least ``current``) of the key so far."""
    own = in_ranges(rows, key, order)
    w = local(key, order)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.col(phase).eqNullSafe(F.lag(phase).over(w)), 0).otherwise(1)
    own = own.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w))
    bound = F.when(F.col(total).isNotNull(), F.greatest(total, current))
    so_far = Window.partitionBy("part", *key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"shown": F.max(current).over(so_far), "shown_total": F.max(bound).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    turn = F.struct(*order)
    last_run = F.max("_run").over(Window.partitionBy("part", *key))
    sums = own.withColumn("_last", last_run).groupBy("part", *key).agg(
        F.max("_run").alias("changes"),
        F.min_by(F.struct(phase), turn).alias("first"),
        F.max_by(F.struct(phase), turn).alias("last"),
        F.max(F.when(F.col("_run") == F.col("_last"), F.col(current))).alias("tail"),
        F.max(bound).alias("most"),
    )
    by_turn = Window.partitionBy(*key).orderBy("part")
    sums = sums.withColumn("fresh", F.when(F.lag("last").over(by_turn).isNull(), True).otherwise(~F.col("first").eqNullSafe(F.lag("last").over(by_turn))))
    # a range whose rows all go on with the run before leaves that run open
    sums = sums.withColumn("_reset", F.sum((F.col("fresh") | (F.col("changes") > 0)).cast("int")).over(by_turn))
    sums = sums.withColumn("open", F.max("tail").over(Window.partitionBy(*key, "_reset").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    runs = F.col("changes") + F.col("fresh").cast("int")
    before = carried(
        sums, key,
        _runs=F.coalesce(F.sum(runs).over(turns(key)), F.lit(0)) + F.col("fresh").cast("int"),
        _open=F.when(~F.col("fresh"), F.lag("open").over(by_turn)),
        _most=F.max("most").over(turns(key)),
    )
    out = with_carry(own, before, key)
    shown = F.when(F.col("_run") == 0, F.greatest("shown", "_open")).otherwise(F.col("shown"))
    run = (F.col("_run") + F.coalesce("_runs", F.lit(1))).cast("long")
    return out.withColumns({"run": run, "shown": shown, "shown_total": F.greatest("shown_total", "_most")}).drop("part", "_change", "_run", "_runs", "_open", "_most")
