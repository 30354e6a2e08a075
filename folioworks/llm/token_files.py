"""Token ids in files of directly addressable codes.

Each id is split into chunks of eight bits.  Level 0 holds the lowest chunk of
every id, level 1 the next chunk of the ids that have one, and so on; a
continuation bitmap at each level says which ids go on, and a rank directory
(ones before every 512 bits) tells where they lie one level up.  So token ``i``
is read with one rank a level, and no block is decoded.

A file is a Parquet file of segments: rows of ``part, seg, first_id, last_id,
doc_ids, ends, levels`` whose binary columns are the code levels, uncompressed.
Parts ascend in document id, segments ascend in a part; the first and last id of
a segment let a lookup skip the others.  Spark's writer commits files, so a lost
executor costs a retried task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path, partitions, small_batches
from .tokens import batches_by_bytes, encoder, tokenizer_kind

RANK_BITS = 512
SEGMENT_TOKENS = 1 << 18
LEVEL = pa.struct([("codes", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())])
SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("levels", pa.list_(LEVEL))])
SEGMENT_DDL = "part int, seg int, first_id bigint, last_id bigint, doc_ids array<bigint>, ends array<bigint>, levels array<struct<codes binary, more binary, ranks binary>>"


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The code levels of unsigned 32-bit ids; at least one level, at most four."""
    out, left = [], ids.astype(np.uint32)
    while True:
        rest = left >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8), dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        out.append({"codes": (left & 255).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return out
        left = rest[more]


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, levels: list[dict[str, bytes]]) -> None:
        self.levels = [(np.frombuffer(x["codes"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def rank(self, level: int, i: int) -> int:
        """Ids among the first ``i`` of a level that go on to the next."""
        _, more, ranks = self.levels[level]
        block = i // RANK_BITS
        n = int(ranks[block]) + int(np.bitwise_count(more[block * (RANK_BITS // 8) : i // 8]).sum())
        return n + (int(more[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, (codes, more, _) in enumerate(self.levels):
            value |= int(codes[i]) << shift
            if not more[i // 8] >> i % 8 & 1:
                break
            i, shift = self.rank(level, i), shift + 8
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of positions ``start`` to ``end``, touching only their own codes."""
        out = np.zeros(end - start, np.uint32)
        at, a, b = np.arange(end - start), start, end
        for level, (codes, more, _) in enumerate(self.levels):
            out[at] |= codes[a:b].astype(np.uint32) << np.uint32(8 * level)
            if b == a or level + 1 == len(self.levels):
                break
            bits = np.unpackbits(more[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            at, a = at[bits], self.rank(level, a)
            b = a + len(at)
        return out


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encode every whole text, append ``end_id``, write in ascending id order; returns the path.

    Null and empty texts have ``end_id`` alone.  Null ids come first, repeated
    rows stay side by side, an empty table writes no segments.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_path(spark, "token-files")
    kind = tokenizer_kind(tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seg = encoder(tokenizer_path, kind), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        ends: list[int] = []
        tokens = 0

        def full() -> pa.RecordBatch:
            levels = encode_levels(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pydict({"part": [part], "seg": [seg], "first_id": [names[0]], "last_id": [names[-1]], "doc_ids": [names], "ends": [ends], "levels": [levels]}, schema=SEGMENT)

        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for run in batches_by_bytes(batch.column(1), 1 << 20):
                for coded in own.encode_many(run):
                    ids += (coded, end)
                    names.append(next(keys))
                    tokens += len(coded) // 4 + 1
                    ends.append(tokens)
                    if tokens >= SEGMENT_TOKENS:
                        yield full()
                        seg, tokens = seg + 1, 0
                        ids, names, ends = [], [], []
        if names:
            yield full()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).repartitionByRange(partitions(spark), "id").sortWithinPartitions("id")
    ordered.mapInArrow(segments, SEGMENT_DDL).write.option("compression", "uncompressed").parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row a document from the files: ``id_col, start, n_tokens, ids_crc32`` (and ``ids``)."""
    ddl = "part int, seg int, id bigint, local bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * with_ids]
        names = ["part", "seg", "id", "local", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.array([0, *row["ends"]], np.int64)
                ids = Codes(row["levels"]).span(0, int(ends[-1])).astype("<u4")
                data, cuts, n = memoryview(ids.tobytes()), (4 * ends).tolist(), len(row["ends"])
                sums = [zlib.crc32(data[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
                columns = [[row["part"]] * n, [row["seg"]] * n, row["doc_ids"], ends[:-1], np.diff(ends), sums]
                if with_ids:
                    columns.append([ids[a:z].tolist() for a, z in zip(ends, ends[1:], strict=False)])
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.schema(SEGMENT_DDL).parquet(path).select("part", "seg", "doc_ids", "ends", "levels")
    sums = files.select("part", "seg", F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    # one row a write task; then the segments of a task among themselves
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0)).alias("part_base"))
    bases = sums.join(parts, "part").select("part", "seg", (F.col("part_base") + F.coalesce(F.sum("n").over(earlier.partitionBy("part").orderBy("seg")), F.lit(0))).alias("base"))
    docs = files.mapInArrow(documents, ddl).join(bases, ["part", "seg"])
    return docs.select(F.col("id").alias(id_col), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


#: Positions that one call looks up.
MAX_LOOKUPS = 1000


def tokens_at(spark: SparkSession, path: str, wanted: list[tuple[int, int]], id_col: str = "doc_id") -> DataFrame:
    """``id_col, position, token_id`` of at most ``MAX_LOOKUPS`` pairs of a document and a position in it.

    Only segments whose first and last id enclose a wanted id are read, and in
    them only the codes of the wanted tokens.  Positions outside a document
    and unknown documents give no row; rows that share an id answer each.
    """
    if len(wanted) > MAX_LOOKUPS:
        raise ValueError(f"at most {MAX_LOOKUPS} positions a call")
    places: dict[int, list[int]] = {}
    for doc, at in wanted:
        places.setdefault(doc, []).append(at)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                codes = Codes(row["levels"])
                for doc, start, end in zip(row["doc_ids"], [0, *row["ends"]], row["ends"], strict=False):
                    out += [(doc, at, codes[start + at]) for at in places.get(doc, ()) if 0 <= at < end - start]
            columns = [[r[i] for r in out] for i in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "position", "token_id"])

    files, near = spark.read.schema(SEGMENT_DDL).parquet(path), F.lit(False)
    for doc in places:
        near = near | ((F.col("first_id") <= doc) & (F.col("last_id") >= doc))
    found = files.filter(near).select("doc_ids", "ends", "levels").mapInArrow(look, "id bigint, position bigint, token_id bigint")
    return found.withColumnRenamed("id", id_col)
