"""An exact index of vectors and keyword postings, in blocks that tasks search alone.

Points go to the nearest of some centres, and a cluster's points to blocks of at
most ``BLOCK``.  A block holds its points' vectors, one-byte approximations of them
with the length of what they miss, and the postings of its terms.  A search

1. takes each query to its nearest cluster, which gives a first k-th best score;
2. takes it to the other clusters that may hold a better one by the triangle
   inequality (centre and radius of the cluster);
3. in a block, bounds every score from both sides by the approximations, and
   computes only those that may be among the k best.

So results are those of comparing all pairs.  The keyword leg takes the points with
any of a query's terms: the block's postings are joined to one bitmap, its rarest
terms first, until it holds every point, and cut to the allowed ones.  Only the k best points of a block
leave its task.  Centres are at most ``CENTRES`` points drawn by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import work_path

BLOCK, CENTRES, PER_CENTRE = 4096, 1024, 2048
#: Queries that meet a block at once; rounding of scores, and of sums in single precision by length.
TOGETHER, SLACK, SINGLE = 256, 2e-6, 2e-5
FIELDS = "vectors binary, codes binary, scales binary, errors binary, allowed binary, words binary, starts binary, posts binary"


@dataclass(frozen=True)
class Index:
    """Written blocks, the centres with the radius of their clusters, and what scores mean."""

    blocks: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    distance: str


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _vectors(column: pa.Array, size: int, distance: str) -> np.ndarray:
    own = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return _unit(own) if distance == "cosine" else own


def build_index(points: DataFrame, distance: str = "cosine") -> Index:
    """The index of ``points(point_id, vector)`` and, where they are there, ``terms`` and ``allowed``.

    Points without a vector, or with one of another size than the first centre's, are left out.
    """
    spark = points.sparkSession
    own = points.select(
        "point_id", "vector",
        F.coalesce(F.transform("terms", lambda t: F.xxhash64(t)), F.array()).cast("array<bigint>").alias("terms") if "terms" in points.columns else F.array().cast("array<bigint>").alias("terms"),
        F.coalesce("allowed", F.lit(False)).alias("allowed") if "allowed" in points.columns else F.lit(True).alias("allowed"),
    ).filter("vector IS NOT NULL")
    path = work_path(spark, "points")
    own.write.parquet(path)
    own = spark.read.schema(own.schema).parquet(path)
    n = own.count()
    drawn = own.orderBy(F.xxhash64("point_id"), "point_id").limit(min(CENTRES, max(1, -(-n // PER_CENTRE)))).select("vector").collect()  # at most CENTRES vectors
    size = len(drawn[0][0]) if drawn else 0
    own = own.filter(F.size("vector") == size)
    centres = np.array([r[0] for r in drawn if len(r[0]) == size], np.float64) if drawn else np.zeros((0, 0))
    centres = _unit(centres) if distance == "cosine" else centres
    id_type = points.schema["point_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(1), size, distance)
                near = ((centres * centres).sum(axis=1) - 2 * (v @ centres.T)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], names=["cluster", *batch.schema.names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, number = None, [], 0
        for batch in batches:
            heads = batch.select(["cluster", "part"]).to_pandas().to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(axis=1)])).tolist() if batch.num_rows else []
            for a, z in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if tuple(heads[a]) != key:
                    if held:
                        yield _packed(key, number, held, size, distance, centres)
                    key, held, number = tuple(heads[a]), [], 0
                for at in range(a, z, BLOCK):
                    held.append(batch.slice(at, min(BLOCK, z - at)))
                    if sum(h.num_rows for h in held) >= BLOCK:
                        yield _packed(key, number, held, size, distance, centres)
                        held, number = [], number + 1
        if held:
            yield _packed(key, number, held, size, distance, centres)

    parts = max(1, -(-n // (len(centres) * BLOCK))) if len(centres) else 1
    placed = own.mapInArrow(assign, f"cluster int, point_id {id_type}, vector {points.schema['vector'].dataType.simpleString()}, terms array<bigint>, allowed boolean")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(parts)).cast("int")).select("cluster", "part", "point_id", "vector", "terms", "allowed")
    placed = placed.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "point_id")
    path = work_path(spark, "vector-index")
    placed.mapInArrow(pack, f"cluster int, block bigint, n int, radius double, ids array<{id_type}>, {FIELDS}").write.parquet(path)
    blocks = spark.read.parquet(path)
    radii = np.full(len(centres), -1.0)
    for cluster, radius in blocks.groupBy("cluster").agg(F.max("radius")).collect():  # at most CENTRES rows
        radii[cluster] = radius
    return Index(blocks, centres, radii, distance)


def _packed(key: tuple[int, int], number: int, held: list[pa.RecordBatch], size: int, distance: str, centres: np.ndarray) -> pa.RecordBatch:
    own = pa.Table.from_batches(held).combine_chunks()
    v = _vectors(own["vector"].combine_chunks(), size, distance)
    scales = np.maximum(np.abs(v).max(axis=1, initial=0.0), 1e-300) / 127
    codes = np.rint(v / scales[:, None]).astype(np.int8)
    errors = np.sqrt(((v - codes * scales[:, None]) ** 2).sum(axis=1)) * (1 + 1e-6)
    terms = own["terms"].combine_chunks()
    hashes = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(v)), np.diff(terms.offsets.to_numpy()))
    by = np.lexsort((rows, hashes))
    words, starts = np.unique(hashes[by], return_index=True)
    radius = float(np.sqrt(((v - centres[key[0]]) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
    parts = [v, codes, scales, errors, np.packbits(own["allowed"].to_numpy().astype(bool)), words, starts.astype("<u4"), rows[by].astype("<u2")]
    arrays = [pa.array([key[0]], pa.int32()), pa.array([(key[1] << 24) + number], pa.int64()), pa.array([len(v)], pa.int32()), pa.array([radius]), pa.array([own["point_id"].to_pylist()], pa.list_(own.schema.field("point_id").type))]
    arrays += [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]
    return pa.RecordBatch.from_arrays(arrays, names=["cluster", "block", "n", "radius", "ids", *(f.split()[0] for f in FIELDS.split(", "))])


class Block:
    """One block in a task."""

    def __init__(self, row: dict, size: int, distance: str) -> None:
        n = row["n"]
        self.ids, self.distance = row["ids"], distance
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.vectors = get("vectors", "<f8").reshape(n, size)
        self.approximate = (get("codes", np.int8).reshape(n, size) * get("scales", "<f8")[:, None]).astype(np.float32)
        self.errors, self.squares = get("errors", "<f8"), (self.vectors**2).sum(axis=1)
        self.allowed = np.unpackbits(get("allowed", np.uint8))[:n].astype(bool)
        self.words, self.posts = get("words", "<i8"), get("posts", "<u2")
        self.starts = np.append(get("starts", "<u4").astype(np.int64), len(self.posts))

    def score(self, dots: np.ndarray, squares: np.ndarray, own: np.ndarray) -> np.ndarray:
        return -np.sqrt(np.maximum(0.0, squares + own - 2 * dots)) if self.distance == "euclid" else dots

    def having(self, terms: np.ndarray) -> np.ndarray:
        """The allowed points with any of the terms; the rarest of the block's terms are joined first, until all points are there."""
        out = np.zeros(len(self.ids), bool)
        at = np.searchsorted(self.words, terms)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == terms)] if len(self.words) else at[:0]
        sizes = self.starts[at + 1] - self.starts[at]
        left = len(self.ids)
        for t in at[np.argsort(sizes)].tolist():
            own = self.posts[self.starts[t] : self.starts[t + 1]]
            left -= np.count_nonzero(~out[own])
            out[own] = True
            if not left:
                break
        return out & self.allowed

    def best(self, queries: np.ndarray, fit: np.ndarray, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, point and score of each query's k best fitting points of the block."""
        squares = (queries**2).sum(axis=1)[:, None]
        dots = (queries.astype(np.float32) @ self.approximate.T).astype(np.float64)
        reach = np.sqrt(squares) * (self.errors + SINGLE * np.sqrt(self.squares))[None, :]
        low, high = self.score(dots - reach, squares, self.squares), self.score(dots + reach, squares, self.squares)
        low = np.where(fit, low, -np.inf)
        bound = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k, None] if low.shape[1] > k else np.full((len(low), 1), -np.inf)
        if threshold is not None:
            bound = np.maximum(bound, threshold)
        row, column = np.nonzero(fit & (high + SLACK >= bound))
        scores = np.empty(len(row))
        for a in range(0, len(row), 1 << 16):
            r, c = row[a : a + (1 << 16)], column[a : a + (1 << 16)]
            scores[a : a + (1 << 16)] = self.score(np.einsum("ij,ij->i", queries[r], self.vectors[c]), squares[r, 0], self.squares[c])
        self.scored = len(row)
        by = np.lexsort((column, -np.round(scores, 6), row))
        row, column, scores = row[by], column[by], scores[by]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(row) > 0])) if len(row) else np.zeros(0, np.int64)
        few = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row)))) < k
        return row[few], column[few], scores[few]


def search_index(index: Index, queries: DataFrame, k: int, threshold: float | None = None, legs: tuple[str, ...] = ("vector",), with_work: bool = False) -> DataFrame:
    """``leg, query_id, point_id, score``: a superset of each query's k best points by leg, and the k best themselves.

    The vector leg keeps scores of at least ``threshold``; the keyword leg takes
    points with one of the query's ``terms``.  ``with_work`` adds ``scored``, the exact scores
    that a block computed for the row's queries, once a batch of them.
    """
    hashes = F.coalesce(F.array_distinct(F.transform("terms", lambda t: F.xxhash64(t))), F.array()) if "keyword" in legs else F.array()
    own = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), hashes.cast("array<bigint>").alias("hashes")).filter("vector IS NOT NULL")
    visits = own.mapInArrow(_visits(index), f"query_id {own.schema['query_id'].dataType.simpleString()}, vector array<double>, hashes array<bigint>, cluster int, bound double, turn int")
    if len(index.centres) < 2:
        return _searched(index, visits, k, threshold, legs, with_work)
    path = work_path(queries.sparkSession, "visits")
    visits.write.parquet(path)
    visits = queries.sparkSession.read.schema(visits.schema).parquet(path)
    first = _searched(index, visits.filter("turn = 0"), k, threshold, legs, with_work)
    path = work_path(queries.sparkSession, "first-hits")
    first.write.parquet(path)
    first = queries.sparkSession.read.schema(first.schema).parquet(path)
    order = Window.partitionBy("leg", "query_id").orderBy(F.desc("score"))
    kth = first.filter("score IS NOT NULL").withColumn("r", F.row_number().over(order)).filter(F.col("r") == k)
    kth = kth.groupBy("query_id").agg(*[F.max(F.when(F.col("leg") == leg, F.col("score"))).alias(f"{leg}_kth") for leg in legs])
    rest = visits.filter("turn > 0").join(kth, "query_id", "left")
    useful = F.lit(False)
    for leg in legs:
        floor = F.coalesce(f"{leg}_kth", F.lit(float("-inf")))
        if leg == "vector" and threshold is not None:
            floor = F.greatest(floor, F.lit(float(threshold)))
        useful = useful | ((F.col("bound") + SLACK >= floor) & (F.lit(leg == "vector") | (F.size("hashes") > 0)))
    rest = rest.filter(useful).select(*visits.columns)
    return first.unionByName(_searched(index, rest, k, threshold, legs, with_work))


def _visits(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    centres, radii, distance = index.centres, index.radii, index.distance

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(centres):
                continue
            q = _vectors(batch.column(1), centres.shape[1], distance)
            squares = (q * q).sum(axis=1)[:, None]
            apart = np.sqrt(np.maximum(0.0, squares + (centres * centres).sum(axis=1) - 2 * (q @ centres.T)))
            near = np.maximum(0.0, apart - radii - 1e-7)
            bound = -near if distance == "euclid" else 1 - near**2 / 2 if distance == "cosine" else q @ centres.T + np.sqrt(squares) * (radii + 1e-7)
            if distance == "cosine":  # beside a zero vector the bound is 0
                bound = np.maximum(bound, 0.0)
            turn = np.argsort(np.argsort(np.where(radii >= 0, apart, np.inf), axis=1), axis=1)
            row, cluster = np.nonzero(np.broadcast_to(radii >= 0, bound.shape))
            taken = batch.take(pa.array(row))
            more = [pa.array(cluster.astype(np.int32)), pa.array(bound[row, cluster]), pa.array(turn[row, cluster].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*taken.columns, *more], names=[*batch.schema.names, "cluster", "bound", "turn"])

    return visit


def _searched(index: Index, visits: DataFrame, k: int, threshold: float | None, legs: tuple[str, ...], with_work: bool) -> DataFrame:
    """The k best points of every block that a query visits."""
    size, distance = index.centres.shape[1], index.distance
    id_type = index.blocks.schema["ids"].dataType.elementType.simpleString()
    query_type = visits.schema["query_id"].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]
    asked = visits.join(index.blocks.select("cluster", "block"), "cluster").select("cluster", "block", F.lit(1).alias("role"), "query_id", "vector", "hashes")
    none = lambda t: F.lit(None).cast(t)
    blocks = index.blocks.select("cluster", "block", F.lit(0).alias("role"), none(query_type).alias("query_id"), none("array<double>").alias("vector"), none("array<bigint>").alias("hashes"), "n", "ids", *names)
    asked = asked.select("*", none("int").alias("n"), none(f"array<{id_type}>").alias("ids"), *[none("binary").alias(x) for x in names])
    rows = blocks.unionByName(asked).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "role")
    ddl = f"leg string, query_id {query_type}, point_id {id_type}, score double" + (", scored bigint" if with_work else "")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def meet() -> Iterator[pa.RecordBatch]:
            ids, q, hashes = [r[0] for r in held], np.array([r[1] for r in held], np.float64).reshape(-1, size), [r[2] for r in held]
            q = _unit(q) if distance == "cosine" else q
            for leg in legs:
                fit = np.broadcast_to(block.allowed, (len(q), len(block.ids))) if leg == "vector" else np.stack([block.having(np.array(h, np.int64)) for h in hashes])
                row, column, scores = block.best(q, fit, k, threshold if leg == "vector" else None)
                found = {"leg": [leg] * len(row), "query_id": [ids[r] for r in row.tolist()], "point_id": [block.ids[c] for c in column.tolist()], "score": scores.tolist()}
                if with_work:
                    found = {n: [*v, None] for n, v in found.items()} | {"scored": [None] * len(row) + [block.scored]}
                yield pa.RecordBatch.from_pydict(found, schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                kinds = [("leg", pa.string()), ("query_id", batch.schema.field("query_id").type), ("point_id", batch.schema.field("ids").type.value_type), ("score", pa.float64())]
                schema = pa.schema([*kinds, ("scored", pa.int64())] if with_work else kinds)
            for r in range(batch.num_rows):
                if batch.column(2)[r].as_py() == 0:
                    if held:
                        yield from meet()
                    row = {name: batch.column(name)[r].as_py() for name in ("n", "ids", *names)}
                    block, held = Block(row, size, distance), []
                    continue
                held.append([batch.column(c)[r].as_py() for c in (3, 4, 5)])
                if len(held) == TOGETHER:
                    yield from meet()
                    held = []
        if held:
            yield from meet()

    return rows.mapInArrow(search, ddl)
