"""Hard negatives of anchors by exact integer scores from packed products.

Components become whole numbers, ``floor(scale * x)``, and a row's score is its
inner product with the anchor.  Two passes over the grid of anchor blocks and
candidate blocks look for each anchor's best rows of its own label, and for the
best rows of other labels below each of those positives.

Inside a pair of blocks several candidates share one wide integer for every
component (a Kronecker packing): each has a field of its own, and a bias keeps
the fields from borrowing of each other.  A multiplication of that integer by
an anchor's component scores all of them at once; after the last component the
biases are taken off and the fields unpacked.  The width of a field comes from
the largest squared length of all rows, which bounds every score (Cauchy and
Schwarz), so the sums are exact.  Integers of 64 bits hold two fields or more;
where longer vectors need more, Python's unbounded integers take their place.

Anchors are dealt to blocks of about ``ANCHORS`` by a hash of their id, other
rows to blocks of one label's ``CANDIDATES`` rows; a block of anchors meets the
candidate blocks in as many tasks as these need, and only the best rows of a task
leave it.  The work is anchors times rows, as the query set asks; nothing of it is
collected, broadcast or gathered by label.

Rows with a null id, label or vector, or with a null or non-finite component take
no part.  A shorter vector counts as continued with zeros.  An id names a row:
where rows share one, the smallest by label, then vector, stands for them.  Ties
go to the smaller id.  Scores beyond 64 bits stop the job.  Empty tables, and
anchors without positives or negatives, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import partitions, small_batches, written

ANCHORS, CANDIDATES = 1024, 384
#: Candidate blocks of one task and block of anchors.
BLOCKS = 64
#: Fields of a wide integer that does not fit 64 bits.
WIDE = 8
BLOCK = "ids binary, labels binary, vectors binary"


@dataclass(frozen=True)
class Fields:
    """How scores are packed: components, scale, bits of a field, fields of an integer."""

    size: int
    scale: float
    bits: int
    number: int
    kind: type

    @classmethod
    def of(cls, size: int, scale: float, longest: float) -> Fields:
        """For scores whose absolute value is at most ``longest``."""
        bits = int(longest * 1.000001 + 1).bit_length() + 1
        return cls(size, scale, bits, 64 // bits, np.uint64) if bits <= 32 else cls(size, scale, bits, WIDE, object)

    def components(self, vectors: bytes, rows: int) -> np.ndarray:
        """Whole components, a row a vector."""
        floors = np.floor(self.scale * np.frombuffer(vectors, "<f8").reshape(rows, self.size))
        return floors.astype(np.int64) if self.kind is np.uint64 else np.array([[int(x) for x in row] for row in floors], object).reshape(rows, self.size)

    def scores(self, anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Inner products of all anchors (rows) with all candidates (columns)."""
        n, unsigned = len(candidates), self.kind is np.uint64
        each = -(-n // self.number)
        own = np.zeros((each * self.number, self.size), candidates.dtype)
        own[:n] = candidates
        bias = max(0, -own.min()) if own.size else 0
        own = (own + bias).astype(self.kind).reshape(self.number, each, self.size)
        shifts = [self.kind(self.bits * f) if unsigned else self.bits * f for f in range(self.number)]
        packed = sum((own[f] << shifts[f] for f in range(self.number)), np.zeros((each, self.size), self.kind))
        # modulo 2 ** 64 a negative component is its complement; the fields of the sum are right all the same
        factors = anchors.astype(self.kind)
        sums = np.einsum("ad,pd->ap", factors, packed) if unsigned else factors @ packed.T
        ones = np.array([sum(1 << self.bits * f for f in range(self.number))], self.kind)
        half = 1 << self.bits - 1
        offset = np.array([half], self.kind) - (anchors.sum(axis=1) * bias).astype(self.kind)
        sums = sums + (offset * ones)[:, None]
        mask = self.kind((1 << self.bits) - 1) if unsigned else (1 << self.bits) - 1
        fields = [(sums >> s & mask).astype(np.int64 if unsigned else object) - half for s in shifts]
        return np.concatenate(fields, axis=1)[:, :n]


class Best:
    """The ``k`` best candidates of every anchor and slot, by score, then smaller id."""

    def __init__(self, anchors: int, slots: int, k: int, kind: type) -> None:
        self.k = k
        self.scores = np.zeros((anchors, slots, k), kind)
        self.ids = np.zeros((anchors, slots, k), np.int64)
        self.full = np.zeros((anchors, slots, k), bool)

    def offer(self, at: np.ndarray, slot: int, keys: np.ndarray, allowed: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the anchors ``at``: ``keys`` order a row's candidates (rising ids: falling last part of the key)."""
        n = len(ids)
        full = self.full[at, slot, -1]
        worst = self.scores[at, slot, -1] * n + n - 1 - np.searchsorted(ids, self.ids[at, slot, -1])
        allowed = allowed & (~full[:, None] | (keys > worst[:, None]))
        if np.count_nonzero(allowed) > 4 * self.k * len(at) and n > self.k:
            low = keys.min() - 1
            allowed &= keys >= np.partition(np.where(allowed, keys, low), n - self.k, axis=1)[:, n - self.k, None]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        by = np.lexsort((-keys[row, column], row))
        row, column = row[by], column[by]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0]))
        place = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
        few = place < self.k
        row, column, place = row[few], column[few], place[few]
        touched, line = np.unique(row, return_inverse=True)
        new_scores, new_ids, new_full = np.zeros((len(touched), self.k), self.scores.dtype), np.zeros((len(touched), self.k), np.int64), np.zeros((len(touched), self.k), bool)
        new_scores[line, place], new_ids[line, place], new_full[line, place] = scores[row, column], ids[column], True
        there = at[touched]
        s, i, f = (np.concatenate([old[there, slot], new], axis=1) for old, new in ((self.scores, new_scores), (self.ids, new_ids), (self.full, new_full)))
        by = np.lexsort((i, -s, ~f), axis=1)[:, : self.k]
        self.scores[there, slot], self.ids[there, slot], self.full[there, slot] = (np.take_along_axis(x, by, axis=1) for x in (s, i, f))


def in_blocks(rows: DataFrame, key: str, size: int, most: int, more: str = "") -> DataFrame:
    """Rows ``key, first`` and ``BLOCK``: up to ``most`` rows of one key that meet in a task, by id; ``more`` names a list column to carry."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        count = 0

        def block(own_key: int) -> pa.RecordBatch:
            own = sorted(held.pop(own_key), key=lambda r: r[0])
            vectors = np.zeros((len(own), size))
            for row, r in zip(vectors, own, strict=True):
                row[: len(r[2])] = r[2]
            columns = [np.array([r[0] for r in own], "<i8").tobytes(), np.array([r[1] for r in own], "<i8").tobytes(), vectors.astype("<f8").tobytes()]
            arrays = [pa.array([own_key], pa.int64()), pa.array([own[0][0]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)]
            if more:
                arrays.append(pa.array([[r[3] for r in own]], pa.list_(pa.list_(pa.int64()))))
            return pa.RecordBatch.from_arrays(arrays, names=["key", "first", "ids", "labels", "vectors", *([more] if more else [])])

        for batch in batches:
            for own_key, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                held.setdefault(own_key, []).append(row)
                count += 1
                if len(held[own_key]) == most:
                    yield block(own_key)
                    count -= most
                if count > 64 * most:  # very many keys: blocks of fewer rows
                    for k in list(held):
                        yield block(k)
                    count = 0
        for k in list(held):
            yield block(k)

    own = rows.select(F.col(key).cast("long").alias("key"), "id", "label", "vector", *([more] if more else []))
    return own.mapInArrow(pack, f"key bigint, first bigint, {BLOCK}" + (f", {more} array<array<bigint>>" if more else ""))


def best_rows(anchors: DataFrame, n_anchors: int, blocks: DataFrame, fields: Fields, n_rows: int, k: int, windows: bool, slots: int, low: int, high: int) -> DataFrame:
    """``anchor_id, slot, score, id``: the ``k`` best of each anchor.

    Without ``windows`` among the rows of its own label, else for each of its
    ``positives`` (a list of scores, a slot each) among the rows of other labels
    whose score is between ``low`` and ``high`` percent of it.
    """
    spark = anchors.sparkSession
    groups = max(1, -(-n_anchors // ANCHORS))
    parts = max(-(-n_rows // (CANDIDATES * BLOCKS)), -(-2 * partitions(spark) // groups))
    dealt = anchors.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups))).repartition(min(groups, partitions(spark)), "grp")
    own = in_blocks(dealt, "grp", fields.size, ANCHORS, "positives").select(F.col("key").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("role"), "ids", "labels", "vectors", "positives")
    none = F.lit(None).cast("array<array<bigint>>").alias("positives")
    others = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("role"), "ids", "labels", "vectors", none)
    rows = own.unionByName(others).repartition(partitions(spark), "grp", "part").sortWithinPartitions("grp", "part", "role")
    exact = np.int64 if fields.bits + CANDIDATES.bit_length() < 63 else object

    class Group:
        """The anchors of one block and their best rows so far."""

        def __init__(self) -> None:
            self.ids, self.labels, self.parts, self.lists = [], [], [], []
            self.best: Best | None = None

        def add(self, ids: np.ndarray, labels: np.ndarray, vectors: bytes, lists: list) -> None:
            self.ids.append(ids)
            self.labels.append(labels)
            self.parts.append(fields.components(vectors, len(ids)))
            self.lists += lists

        def ready(self) -> None:
            self.id, self.label, self.vector = np.concatenate(self.ids), np.concatenate(self.labels), np.concatenate(self.parts)
            self.best = Best(len(self.id), slots, k, exact)
            self.low, self.high = np.zeros((len(self.id), slots), exact), np.full((len(self.id), slots), -1, exact)
            for i, scores in enumerate(self.lists if windows else []):
                for j, p in enumerate(scores):
                    self.low[i, j], self.high[i, j] = -(-low * p // 100), high * p // 100

        def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: bytes) -> None:
            same = np.isin(self.label, labels)
            at = np.arange(len(self.id)) if windows else np.flatnonzero(same)
            if not len(at):
                return
            scores = fields.scores(self.vector[at], fields.components(vectors, len(ids))).astype(exact)
            keys = scores * len(ids) + (len(ids) - 1 - np.arange(len(ids)))
            alike = self.label[at][:, None] == labels[None, :]
            if not windows:
                self.best.offer(at, 0, keys, alike & (self.id[at][:, None] != ids[None, :]), scores, ids)
                return
            for j in range(slots):
                fit = ~alike & (scores >= self.low[at, j][:, None]) & (scores <= self.high[at, j][:, None])
                self.best.offer(at, j, keys, fit, scores, ids)

        def found(self) -> pa.RecordBatch:
            row, slot, place = np.nonzero(self.best.full)
            scores = pa.array([int(s) for s in self.best.scores[row, slot, place]], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(self.id[row]), pa.array(slot.astype(np.int32)), scores, pa.array(self.best.ids[row, slot, place])], names=["anchor_id", "slot", "score", "id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                grp, part, role, ids, labels, vectors, lists = (batch.column(c)[r].as_py() for c in range(7))
                if (grp, part) != key:
                    if group is not None and group.best is not None:
                        yield group.found()
                    key, group = (grp, part), Group()
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                if role == 0:
                    group.add(ids, labels, vectors, lists)
                elif group.ids:  # a group without anchors has nothing to find
                    if group.best is None:
                        group.ready()
                    group.meet(ids, labels, vectors)
        if group is not None and group.best is not None:
            yield group.found()

    found = rows.mapInArrow(search, "anchor_id bigint, slot int, score bigint, id bigint")
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: float = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` tells the anchors by the column ``id``.
    """
    spark = rows.sparkSession
    small_batches(spark)
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(sound)
    repeats = written(own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "repeats")
    if repeats.limit(1).count():
        one = own.join(repeats, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m"))
        own = own.join(repeats, "id", "left_anti").unionByName(one.select("id", "m.label", "m.vector"))
    own = written(own, "vectors")
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x) * F.lit(abs(float(scale))) + 1, F.lit(2.0)))
    n, n_anchors, size, longest = own.agg(F.count(F.lit(1)), F.count_if(is_anchor), F.max(F.size("vector")), F.max(squared)).first()
    fields = Fields.of(size or 0, float(scale), longest or 0.0)
    blocks = written(in_blocks(own, "label", fields.size, CANDIDATES), "blocks")
    anchors = own.filter(is_anchor)
    none = F.lit(None).cast("array<bigint>").alias("positives")
    near = best_rows(anchors.select("*", none), n_anchors, blocks, fields, n, positives, False, 1, low, high)
    near = written(near.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    lists = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    asked = anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id").select("id", "label", "vector", "positives")
    far = best_rows(asked, n_anchors, blocks, fields, n, negatives, True, positives, low, high)
    far = far.select("anchor_id", "slot", F.col("rank").cast("int").alias("rank"), F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    return far.join(near, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
