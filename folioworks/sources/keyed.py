"""Tables in hash buckets that are changed by key: only buckets with changes are written anew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import work_path


def last_changes(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row with the largest ``order`` (all columns decide between equal ones)."""
    rest = [c for c in changes.columns if c not in (*key, *order)]
    row = F.max(F.struct(*order, *rest)).alias("row")
    return changes.groupBy(*key).agg(row).select(*key, *[F.col(f"row.{c}").alias(c) for c in (*order, *rest)]).select(*changes.columns)


@dataclass(frozen=True)
class KeyedTable:
    """Parquet files in ``buckets`` folders by a hash of the key.

    The row of a key with the largest ``order`` stands, so repeated changes, changes
    that come late and a second run leave the same table.  A deleted key stays as
    a row that ``read`` does not return.  A job that writes replaces whole
    buckets at its end, so one that fails leaves the table as it was.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """A new table of the rows, the last of each key."""
        own = last_changes(rows, [*self.key], [*self.order]).withColumn("deleted", F.lit(False))
        self._bucketed(own).repartition("bucket").write.partitionBy("bucket").parquet(self.path)

    def change(self, changes: DataFrame, deleted: str | None = None) -> None:
        """Puts the changes into their buckets; those with the flag ``deleted`` take their key away."""
        flag = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        own = changes.withColumn("deleted", flag)
        new = self._bucketed(last_changes(own.drop(deleted) if deleted and deleted != "deleted" else own, [*self.key], [*self.order]))
        # read twice below: a stream's batch must not run its state again
        path = work_path(self.spark, "changes")
        new.write.parquet(path)
        new = self.spark.read.schema(new.schema).parquet(path)
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most one row a bucket
        if touched:
            old = self.spark.read.schema(new.schema).parquet(self.path).filter(F.col("bucket").isin(*touched))
            both = old.select(*new.columns).unionByName(new)
            self._write(self._bucketed(last_changes(both.drop("bucket"), [*self.key], [*self.order])))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).filter("NOT deleted").drop("deleted", "bucket")
