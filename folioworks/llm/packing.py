"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens.  A window of ``window``
tokens is filled in granules; in each window a queue earns its target share
(its part of all tokens) and is served whole granules, and what it was served
too little is its deficit, carried to the next window.  The round is played as
a tournament: the queues stand at the leaves of a binary tree, and each node
shares the granules it is served between its two sides, the left one getting
``floor(n * left / both)`` of the first ``n``.  So at each node the deficit stays
below one granule, both sides only ever grow, and what any queue has been
served after any window is a closed form of a few terms.  Every partition
places its own documents at any window, with the deficits that the rounds
before have left, without playing them.  Tokens beyond a queue's last whole
granule follow at the end, so only the very last sequence is padded.

Texts are encoded once; ids, queue and running sums inside each task are
written, so that they do not change when an executor is lost.

Null texts are empty, a null source is the queue "".  Beyond ``max_queues``
sources, sources share queues by hash.  Repeated rows are packed as often as
they come.  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, written
from .tokens import batches_by_bytes, encoder, tokenizer_kind

WINDOW, GRANULE, MAX_QUEUES = 2048, 128, 4096
#: Rows of per-task sums that are broadcast at most; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str, source_col: str, max_queues: int) -> DataFrame:
    """Written rows ``id, queue, part, before, n, ids``: ``before`` counts the queue's tokens earlier in the task."""
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if docs.select(queue.alias("q")).distinct().count() > max_queues:
        queue = F.pmod(F.xxhash64(queue), F.lit(max_queues)).cast("string")
    kind = tokenizer_kind(tokenizer_path)
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = encoder(tokenizer_path, kind), TaskContext.get().partitionId(), {}
        for batch in batches:
            i = 0
            for run in batches_by_bytes(batch.column(2), 1 << 20):
                ids = [x + end for x in own.encode_many(run)]
                rows = batch.slice(i, len(run))
                i += len(run)
                before, n = [], [len(x) // 4 for x in ids]
                for q, k in zip(rows.column(1).to_pylist(), n, strict=True):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array([part] * len(run), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "queue", "part", "before", "n", "ids"],
                )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), queue.alias("queue"), text.alias("text"))
    return written(narrow.mapInArrow(encode, "id bigint, queue string, part int, before bigint, n bigint, ids binary"), "ids")


class Queues:
    """The tournament over at most ``MAX_QUEUES`` queues, from their tokens."""

    def __init__(self, tokens: dict[str, int], granule: int, window: int) -> None:
        self.granule, self.slots, names = granule, window // granule, sorted(tokens)
        self.granules = {q: tokens[q] // granule for q in names}
        self.total = sum(self.granules.values())
        self.tail_at, tail = {}, self.total * granule
        for q in names:
            self.tail_at[q] = tail
            tail += tokens[q] % granule
        self.path: dict[str, tuple[tuple[bool, int, int], ...]] = {}
        stack = [(names, ())]
        while stack:
            own, path = stack.pop()
            if len(own) <= 1:
                self.path |= {q: path for q in own}
                continue
            half = len(own) // 2
            left, both = sum(self.granules[q] for q in own[:half]), sum(self.granules[q] for q in own)
            stack += [(own[:half], (*path, (False, left, max(1, both)))), (own[half:], (*path, (True, left, max(1, both))))]

    def served(self, queue: str, w: int) -> tuple[int, int, int]:
        """Granules of the queue served before window ``w`` and after it, and those of others before its own in ``w``."""
        a, b, ahead = min(self.slots * w, self.total), min(self.slots * (w + 1), self.total), 0
        for right, left, both in self.path[queue]:
            x, y = a * left // both, b * left // both
            if right:
                a, b, ahead = a - x, b - y, ahead + y - x
            else:
                a, b = x, y
        return a, b, ahead

    def window_of(self, queue: str, q: int) -> int:
        """The window that holds the queue's granule ``q``."""
        rate, share = self.slots * self.granules[queue], q * self.total
        slack = (len(self.path[queue]) + 2) * self.total // rate + 2
        low, high = max(0, share // rate - slack), share // rate + slack
        while low < high:  # the first window after which more than q granules are served
            mid = (low + high) // 2
            low, high = (low, mid) if self.served(queue, mid)[1] > q else (mid + 1, high)
        return low

    def windows(self, queue: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``served`` for the windows from ``first`` to ``last``."""
        a = np.minimum(self.slots * np.arange(first, last + 1), self.total)
        b = np.minimum(self.slots * np.arange(first + 1, last + 2), self.total)
        ahead = np.zeros_like(a)
        for right, left, both in self.path[queue]:
            # the products stay below 2^63 for up to 2^31 granules of a side
            x, y = (a * left // both, b * left // both) if self.total < 1 << 31 else (exact(a, left, both), exact(b, left, both))
            if right:
                a, b, ahead = a - x, b - y, ahead + y - x
            else:
                a, b = x, y
        return a, b, ahead

    def pieces(self, queue: str, first: int, end: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end in the queue, ``sequence_id`` and ``offset`` of the pieces of its tokens from ``first`` to ``end``, cut at ``starts`` too."""
        g, window, main = self.granule, self.slots * self.granule, self.granules[queue] * self.granule
        parts = []
        if first < main:
            stop = min(end, main)
            w = self.window_of(queue, first // g)
            begin, after, ahead = self.windows(queue, w, self.window_of(queue, (stop - 1) // g))
            cuts = np.unique(np.concatenate([[first], after[:-1] * g, starts[(starts > first) & (starts < stop)]]))
            cuts = cuts[cuts >= first]
            own = np.searchsorted(after * g, cuts, side="right")
            parts.append((cuts, np.append(cuts[1:], stop), w + own, (ahead - begin)[own] * g + cuts))
        if end > main:
            low, shift = max(first, main), self.tail_at[queue] - main
            edges = np.arange((low + shift) // window + 1, (end + shift - 1) // window + 1) * window - shift
            cuts = np.unique(np.concatenate([[low], edges, starts[(starts > low) & (starts < end)]]))
            parts.append((cuts, np.append(cuts[1:], end), (cuts + shift) // window, (cuts + shift) % window))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def exact(n: np.ndarray, left: int, both: int) -> np.ndarray:
    return np.array([int(x) * left // both for x in n], np.int64)


def bases(ids: DataFrame) -> tuple[DataFrame, int, dict[str, int]]:
    """By queue and task the stream position at which the task begins; its rows; the tokens by queue."""
    sums = ids.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    own = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    table = written(sums.select("queue", "part", "tokens", F.coalesce(F.sum("tokens").over(own), F.lit(0)).alias("base")), "bases")
    # at most MAX_QUEUES rows
    return table.drop("tokens"), table.count(), {r["queue"]: r["n"] for r in table.groupBy("queue").agg(F.sum("tokens").alias("n")).collect()}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, granule: int = GRANULE, max_queues: int = MAX_QUEUES, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``)."""
    if window % granule:
        raise ValueError("window must be a multiple of granule")
    small_batches(docs.sparkSession)
    ids = encoded(docs, tokenizer_path, end_id, id_col, text_col, source_col, max_queues)
    table, rows, tokens = bases(ids)
    queues = Queues(tokens, granule, window)
    placed = ids.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, ["queue", "part"])
    placed = placed.select("id", "queue", (F.col("base") + F.col("before")).alias("at"), "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, own, sizes = batch.column(0), np.array(batch.column(1).to_pylist(), object), batch.column(3).to_numpy()
            at, coded = batch.column(2).to_numpy(), [memoryview(x.as_buffer()) for x in batch.column(4)]
            # stretches of a queue's tokens without a gap
            order = np.lexsort((at, own)) if len(own) else np.zeros(0, np.int64)
            ends = at + sizes
            breaks = np.flatnonzero((own[order][1:] != own[order][:-1]) | (at[order][1:] != ends[order][:-1])) + 1
            for rows in np.split(order, breaks) if len(order) else []:
                begin, end, sequence, offset = queues.pieces(own[rows[0]], int(at[rows[0]]), int(ends[rows[-1]]), at[rows])
                which = rows[np.searchsorted(at[rows], begin, side="right") - 1]
                start, length = begin - at[which], end - begin
                pieces = [coded[i][4 * a : 4 * (a + k)] for i, a, k in zip(which.tolist(), start.tolist(), length.tolist(), strict=True)]
                sums = np.fromiter(map(zlib.crc32, pieces), np.int64, len(pieces))
                columns = [docs.take(pa.array(which)), *(pa.array(x) for x in (start, length, sums, sizes[which], sequence, offset))]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").tolist() for p in pieces], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    ddl = ", ".join(f"{x} bigint" for x in names) + ", ids array<bigint>" * with_ids
    return placed.mapInArrow(cut, ddl).withColumnRenamed("doc_id", id_col)
