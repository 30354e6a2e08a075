"""Tables laid out for pages: sorted by range, with the least and the largest row of every file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import keyset

#: Files whose ranges are looked at together.
AHEAD = 64


@dataclass(frozen=True)
class PagedTable:
    """Rows sorted by ``column``, then ``ident``; a page reads the one or two files that hold it."""

    spark: SparkSession
    path: str
    column: str
    ident: str

    def create(self, rows: DataFrame, files: int | None = None) -> None:
        files = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col(self.column).asc_nulls_first(), F.col(self.ident)]
        rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/rows")
        place = F.struct(self.column, self.ident)
        ranges = self.spark.read.parquet(f"{self.path}/rows").groupBy(F.input_file_name().alias("file")).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
        ranges.coalesce(1).write.parquet(f"{self.path}/ranges")  # a row a file

    def page(self, size: int, after: tuple | None = None, descending: bool = False) -> DataFrame:
        """``size`` rows and one more, which tells that there are others, after ``(value, id)``.

        Ascending pages start with nulls; within one value ids rise in either direction.
        """
        ranges = self.spark.read.parquet(f"{self.path}/ranges")
        value, ident = (F.col(f"{'low' if descending else 'high'}.{c}") for c in (self.column, self.ident))
        if after:  # a rising page goes on inside a value, so ids tell files apart there too
            ranges = ranges.filter(value <= F.lit(after[0])) if descending else ranges.filter((value > F.lit(after[0])) | ((value == F.lit(after[0])) & (ident > F.lit(after[1]))))
        order = [F.col("high").desc(), F.col("low").desc()] if descending else [F.col("low").asc(), F.col("high").asc()]
        near = ranges.orderBy(*order).limit(AHEAD).collect()
        rows = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/rows").schema)
        if not near:
            return rows.parquet(f"{self.path}/rows").filter(F.lit(False))
        chosen: list[str] = []
        sure, last = 0, None
        for r in near:
            # falling pages have the ids of one value rise, so its files are read together
            if sure > size and (not descending or r["high"][self.column] != last):
                break
            chosen.append(r["file"])
            last, low, high = r["low"][self.column], tuple(r["low"]), r["high"][self.column]
            if after is None or (high < after[0] if descending else low[0] is not None and low > tuple(after)):
                sure += r["n"]
        else:
            if len(near) == AHEAD and sure <= size:  # many small files: Spark's own pruning
                chosen = [f"{self.path}/rows"]
        own = rows.parquet(*chosen)
        if after:
            own = own.filter(keyset(self.column, self.ident, *after, descending=descending))
        return own.orderBy(F.desc(self.column) if descending else F.asc(self.column), self.ident).limit(size + 1)
