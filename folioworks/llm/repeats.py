"""Which 64-bit hashes do several rows have: bit tables of bounded size.

The hashes of all rows are counted as packed bytes, not as rows: a task sends
each hash once, or twice if several of its rows have it, so a hash that very
many rows share is sent a few times by each task.  The tables may also mark a
hash that is not repeated (another one fell on its bit), never the reverse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import partitions

MAX_TABLE_BITS = 1 << 30
#: Packed hashes that a task holds before it sends them.
HELD = 2_000_000
BROADCAST_IDS = 300_000


class BitTables:
    """One table of bits for each residue of the hashes modulo the number of tables."""

    def __init__(self, tables: np.ndarray) -> None:
        self.tables = tables

    @staticmethod
    def place(hashes: np.ndarray, chunks: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        return (hashes % np.uint64(chunks)).astype(np.int64), ((hashes // np.uint64(chunks)) % np.uint64(size)).astype(np.int64)

    def marked(self, hashes: np.ndarray) -> np.ndarray:
        chunk, at = self.place(hashes, len(self.tables), 8 * self.tables.shape[1])
        return (self.tables[chunk, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def repeated(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, chunks: int) -> BitTables:
    """Bit tables of the hashes that at least two rows have; ``hashes_of`` yields each row's distinct hashes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def packed() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            values = np.concatenate([values, values[n > 1]])
            chunk = (values % np.uint64(chunks)).astype(np.int64)
            by = np.argsort(chunk, kind="stable")
            cuts = np.searchsorted(chunk[by], np.arange(chunks + 1)).tolist()
            own = [(c, values[by[a:b]].astype("<u8").tobytes()) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in own], pa.int32()), pa.array([v for _, v in own], pa.binary())], names=["chunk", "hashes"])

        for batch in batches:
            for own in hashes_of(batch):
                held.append(own)
                size += len(own)
                if size > HELD:
                    yield packed()
                    held, size = [], 0
        if size:
            yield packed()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one chunk after the other, as the rows are sorted
        def table() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            flags = np.zeros(bits // chunks, bool)
            flags[BitTables.place(values[n > 1], chunks, bits // chunks)[1]] = True
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

        chunk, held = None, []
        for batch in batches:
            for c, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if c != chunk and held:
                    yield table()
                    held = []
                chunk = c
                held.append(np.frombuffer(hashes, "<u8"))
        if held:
            yield table()

    packed = rows.mapInArrow(pack, "chunk int, hashes binary").repartition(min(chunks, partitions(rows.sparkSession)), "chunk").sortWithinPartitions("chunk")
    out = np.zeros((chunks, bits // chunks // 8), np.uint8)
    for row in packed.mapInArrow(mark, "chunk int, bits binary").collect():  # `bits` bits in all, at most MAX_TABLE_BITS
        out[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return BitTables(out)


def near(left: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """A join with an id table that is broadcast only while it has few rows."""
    return left.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)
