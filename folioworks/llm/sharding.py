"""Sharding by sampled splitters, in DataFrame functions only.

Records are laid on a line ordered by a key hash (equal keys side by side) and
the line is cut into shards of near-equal bytes:

1. size-weighted samples of the key hash are drawn by a hash of the record, so
   a rerun draws the same ones; quantiles of the sample become splitters;
2. a splitter value drawn more than once belongs to a hot key (a large group of
   equal keys), which gets a range of its own;
3. records are dealt to the ranges, the ranges' exact rows and bytes are
   counted, and overfull ranges are subdivided (a hot key by a hash of the id,
   the others along the key);
4. running sums inside the ranges plus the sums of the ranges before give each
   record its exact place on the line, hence its shard and slot.

Records that alone hold over 1/1600 of all bytes (at most 1600 of them) are
dealt first, in a snake over the shards; the light ones fill the shards up to a
common level.  So two shards differ by little more than a light record, unless
single records are larger than a shard's share.

Null keys and texts count as empty, null ids sort first.  Repeated rows are
records of their own.  An empty table gives an empty result.  Columns of the
input other than id, key and size are not carried.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

HEAVY = 1600
RANGE_ROWS = 250_000
SAMPLES_A_RANGE = 24


def _unit(*columns: Column) -> Column:
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def splitters(records: DataFrame, total: int, ranges: int) -> list[float]:
    """Distinct increasing boundaries from -inf to +inf; hot key values are enclosed by two."""
    inf = float("inf")
    if ranges < 2 or total <= 0:
        return [-inf, 0.5, inf]
    share = ranges * SAMPLES_A_RANGE / total
    draw = _unit(F.col("id"), F.col("key"), F.lit("draw"))
    drawn = records.filter(draw < F.col("size") * F.lit(share)).select("key")
    # at most `ranges - 1` boundaries come to the driver
    cuts = drawn.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] or [0.5]
    hot = {a for a, b in pairwise(cuts) if a == b}
    return [-inf, *sorted(set(cuts) | {math.nextafter(x, inf) for x in hot}), inf]


def levels(heavy: list[int], light: int) -> list[int]:
    """Bytes of light records that each shard takes so that all reach one level as far as they can."""
    order = sorted(range(len(heavy)), key=lambda i: (heavy[i], i))
    out, sums = [0] * len(heavy), 0
    for k, i in enumerate(order, 1):
        sums += heavy[i]
        level = (light + sums) / k
        if k == len(order) or level <= heavy[order[k]]:
            for j in order[:k]:
                out[j] = max(0, level - heavy[j])
            return out
    return out


def place(records: DataFrame, shards: int) -> DataFrame:
    """``id, key, size`` (and any other columns) with ``shard`` and ``slot`` added.

    ``records`` must be a written table: it is read several times.
    """
    got = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    rows, total = got["n"], got["bytes"]
    is_heavy = F.col("size") * F.lit(HEAVY) > F.lit(total)
    # at most HEAVY records: each holds over 1/HEAVY of the bytes
    snake = Window.orderBy(F.desc("size"), "key", "id")
    heavy = records.filter(is_heavy).withColumn("r", F.row_number().over(snake) - 1)
    lap, at = F.floor(F.col("r") / shards), F.col("r") % shards
    heavy = written(heavy.withColumn("shard", F.when(lap % 2 == 0, at).otherwise(shards - 1 - at).cast("int")).drop("r"), "heavy")
    sums = {r["shard"]: r for r in heavy.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    held = [sums[i]["b"] if i in sums else 0 for i in range(shards)]
    heavy_rows = sum(r["n"] for r in sums.values())
    light_bytes, light_rows = total - sum(held), rows - heavy_rows

    light = records.filter(~is_heavy)
    ranges = max(4 * shards, -(-light_rows // RANGE_ROWS))
    cuts = splitters(light, light_bytes, ranges)
    light = Bucketizer(splits=cuts, inputCol="key", outputCol="range").transform(light).withColumn("range", F.col("range").cast("int"))
    full = light.groupBy("range").agg(F.count(F.lit(1)).alias("range_rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    most = max(1, 2 * light_rows // ranges)
    full = full.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("range_rows") / most)))
    wide = F.col("hi") - F.col("lo")
    along = F.when(wide > 0, (F.col("key") - F.col("lo")) / wide).otherwise(_unit(F.col("id"), F.lit("part")))
    # one row a range, and at most `ranges` splitters twice over
    cut = light.join(F.broadcast(full), "range").withColumn("part", F.least(F.floor(along * F.col("parts")), F.col("parts") - 1))
    cut = cut.drop("range_rows", "lo", "hi", "parts")
    own = Window.partitionBy("range", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    line = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy("range", "part").agg(F.sum("size").alias("b")).withColumn("base", F.coalesce(F.sum("b").over(line), F.lit(0))).drop("b")
    # as many rows as ranges and their subdivisions, at most 3 * ranges
    placed = cut.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(F.broadcast(before), ["range", "part"])
    middle = F.col("base") + F.col("within") + F.col("size") / 2
    ends, end = [], 0.0
    for x in levels(held, light_bytes)[:-1]:
        end += x
        ends.append(end)
    shard = F.lit(0)
    for x in ends:
        shard = shard + F.when(middle >= F.lit(float(x)), 1).otherwise(0)
    placed = written(placed.withColumn("shard", shard.cast("int")).drop("within", "base"), "placed")
    # slots: rows of the same shard in ranges before, plus the place in this range; heavy records come first
    tallies = placed.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tallies.withColumn("start", F.coalesce(F.sum("n").over(first), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "range", "part").orderBy("key", "id")
    offset = F.element_at(F.create_map(*[F.lit(x) for i in range(shards) for x in (i, sums[i]["n"] if i in sums else 0)]), F.col("shard"))
    placed = placed.withColumn("slot", F.row_number().over(inside)).join(F.broadcast(starts), ["shard", "range", "part"])
    placed = placed.withColumn("slot", (F.col("slot") - 1 + F.col("start") + offset).cast("long")).drop("range", "part", "start")
    ranked = heavy.withColumn("slot", (F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("size"), "key", "id")) - 1).cast("long"))
    return placed.unionByName(ranked)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, shard, slot``: near-equal bytes a shard, equal texts side by side."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    records = docs.select(
        F.col(id_col).alias("id"),
        _unit(text).alias("key"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return place(written(records, "records"), shards).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
