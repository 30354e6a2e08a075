"""MinHash near-duplicate detection.

1. Each document's set of word shingles is hashed and sketched by one
   permutation: the hash space is cut into bins, the smallest hash of a bin is
   its value, and an empty bin takes the value of a bin drawn by a universal
   hash of (bin, attempt) until a full one is met (optimal densification).
2. Documents with equal sets become one class; only its smallest id goes on.
3. Bands of the sketch are buckets.  Members of a bucket are not paired with
   each other but with a few centres (a star): first the member that shares
   most buckets with others, then the smallest id and members drawn at random.
   So a bucket of m members has at most a constant times m candidate edges.
4. Edges between different components are confirmed on the full sets; hubs are
   dealt over as many tasks as their edges need.  ``ROUNDS`` rounds join most of
   what belongs together.
5. What the stars have missed is looked for in all pairs: members in different components
   of a bucket are compared in blocks inside tasks, two slices of about ``SLICE``
   members at a time, by their sizes and by how many bands they share: one at
   least, or ``SHARED`` where both sets have ``BINS`` shingles and more, which
   similar sets miss about as rarely as they miss all buckets; pairs
   that pass are confirmed on the full sets, again in blocks.  Only links leave
   a block, each pair is looked at in its first common bucket, and members of a
   large bucket's largest component are not compared with each other.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text with fewer words
than a shingle has its whole sequence as one; null texts and texts without
words have no shingles and are linked with nothing.  Rows with a null id are
returned with a null component and are not compared.  Repeated rows count as
one node; rows that share an id must share the text.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .repeats import HELD, MAX_TABLE_BITS, near, repeated
from .store import partitions, small_batches, written
from .worker import Remembered, held

BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Edges of one centre that one task confirms.
STAR = 256
#: Rounds of stars; members in a slice of a large bucket.
ROUNDS, SLICE = 2, 256
#: By the sketch's estimate two sets of at least ``BINS`` shingles share fewer bands about 3 times in 10^6 at a similarity of 0.80, 2 in 10^9 at 0.85.
SHARED = 4
#: Cells of a table of a block's members and shingles.
TABLE = 1 << 25
#: Half of the words whose hashes a worker remembers at most, and the longest.
REMEMBERED, LONGEST = 150_000, 48


def word_hashes() -> Remembered:
    """The worker's words and their 64-bit hashes."""
    return held("word hashes", lambda: Remembered(xxhash.xxh3_64_intdigest, REMEMBERED, LONGEST))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(word_hashes().__getitem__, found), np.uint64, n)
    size = min(words, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out + codes[i : n - size + 1 + i])
    return np.unique(out)


def _fillers(bins: int) -> np.ndarray:
    """For each bin the bins tried in turn when it is empty."""
    attempts = 64
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)[None, :]
    return (mixed(grid + np.uint64(0x51ED2701)) % np.uint64(bins)).astype(np.int64)


FILLERS = _fillers(BINS)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One value a bin from sorted distinct hashes (at least one), densified."""
    scaled = mixed(hashes)
    bins = (scaled >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
    order = np.lexsort((scaled, bins))
    first = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) > 0]))
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    at = bins[order[first]].astype(np.int64)
    values[at], full[at] = scaled[order[first]], True
    empty = np.flatnonzero(~full)
    if len(empty):
        tried = full[FILLERS[empty]]
        pick = tried.argmax(axis=1)
        values[empty] = values[FILLERS[empty, pick]]
        for i in empty[~tried[np.arange(len(empty)), pick]]:  # so many misses in a row are rare
            values[i] = values[at[int(i) % len(at)]]
    return values


BAND_SALTS = mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(0xB5297A4D))


def band_keys(values: np.ndarray) -> np.ndarray:
    out = BAND_SALTS.copy()
    for column in values.reshape(BANDS, ROWS).T:
        out = mixed(out + column)
    return out


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Written rows ``id, n, s1, s2, bands``: set size, a 128-bit signature of the set, its band keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, bands = [], [], [], []
            for text in batch.column(1):
                own = shingles(text.as_py(), words)
                n.append(len(own))
                s1.append(int(own.sum(dtype=np.uint64).astype(np.int64)))
                s2.append(int(np.bitwise_xor.reduce(mixed(own + np.uint64(1))).astype(np.int64)) if len(own) else 0)
                bands.append(band_keys(sketch(own)).astype(np.int64) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "s1", "s2", "bands"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(narrow.mapInArrow(make, "id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"), "sketches")


def confirmed(edges: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The edges ``(a, b)`` whose full sets have ``100 * common >= percent * union``.

    A centre ``a`` and its edges are dealt over one task for every ``STAR`` of them.
    """
    spark = edges.sparkSession
    degrees = edges.groupBy("a").agg(F.count(F.lit(1)).alias("d")).select("a", F.ceil(F.col("d") / STAR).alias("parts"))
    degrees = written(degrees, "degrees")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    members = edges.join(degrees, "a").select("a", part.alias("part"), F.lit(1).alias("role"), "b")
    members = members.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "role", "b", "text")
    parts = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    centres = degrees.select("a", parts.alias("part"), F.lit(0).alias("role"), F.col("a").alias("b"))
    centres = centres.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "role", "b", "text")
    rows = members.unionByName(centres).repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "role")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            keys, roles, others, texts_ = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for key, role, other, text in zip(keys, roles, others, texts_, strict=True):
                if role == 0:
                    centre, own = key, shingles(text.as_py(), words)
                    continue
                if key != centre:
                    raise ValueError("the centre's text is missing")
                theirs = shingles(text.as_py(), words)
                common = len(own) + len(theirs) - len(np.union1d(own, theirs))
                if 100 * common >= percent * (len(own) + len(theirs) - common) and common:
                    a.append(key)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(confirm, "a bigint, b bigint")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """Written rows ``id, n, bucket, members`` of the buckets with two members and more, from ``reps(id, n, bands)``."""
    size = BANDS * max(1, reps.count())
    bits = 1 << 16
    while bits < 16 * size and bits < MAX_TABLE_BITS:
        bits *= 2
    chunks = 16
    while chunks * HELD < size:
        chunks *= 2

    def bands_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        bands = batch.column(2)
        values = bands.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, BANDS)
        yield from values

    spread = reps.sparkSession.sparkContext.broadcast(repeated(reps, bands_of, bits, chunks))  # at most MAX_TABLE_BITS bits

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = spread.value
        for batch in batches:
            values = np.stack(list(bands_of(batch))) if batch.num_rows else np.zeros((0, BANDS), np.uint64)
            row, band = np.nonzero(marks.marked(values.ravel()).reshape(values.shape))
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(n[row]), pa.array(values[row, band].view(np.int64))], names=["id", "n", "bucket"])

    # few keys are marked by chance, so nearly all rows below are in crowded buckets
    keys = written(reps.select("id", "n", "bands").mapInArrow(keep, "id bigint, n bigint, bucket bigint"), "keys")
    crowded = written(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "crowded")
    return written(keys.join(crowded, "bucket").select("id", "n", "bucket", "members"), "shared")


def centres_of(placed: DataFrame, turn: int) -> DataFrame:
    """``bucket, centres, low, high``: a round's centres and the range of components, from ``placed(id, n, bucket, score, component)``.

    All buckets draw alike, so that a member is centre of all its buckets and few edges differ;
    what they miss is left to ``block_pairs``.
    """
    me = F.struct("id", "n", "component")
    draw = lambda k: F.max(F.struct(F.xxhash64("id", F.lit(f"{turn}.{k}")), me.alias("c"))).getField("c")
    picks = [F.max(F.struct("score", (-F.col("id")).alias("i"), me.alias("c"))).getField("c")] if not turn else [F.min(me), draw(0), draw(1), draw(2)]
    return placed.groupBy("bucket").agg(F.array_distinct(F.array(*picks)).alias("centres"), F.min("component").alias("low"), F.max("component").alias("high"))


def placed_in(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Written rows of ``shared`` with their components so far."""
    return written(shared.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")


def untried(edges: DataFrame, seen: DataFrame) -> DataFrame:
    pair = lambda df: df.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")})
    return pair(edges).join(pair(seen).select("x", "y"), ["x", "y"], "left_anti").dropDuplicates(["x", "y"]).select("a", "b")


def block_pairs(placed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Written rows ``bucket, i, j, a, b``: by block of a bucket the pairs ``a[k], b[k]`` of different components that may be similar enough."""
    spark = placed.sparkSession
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    open_ = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("top")).filter("components > 1")
    # the largest component of a large bucket has slices of its own, behind those of the others
    large = F.col("m") > SLICE
    tops, rest = F.when(large, F.col("top.m")).otherwise(0), F.when(large, F.col("m") - F.col("top.m")).otherwise(F.col("m"))
    open_ = open_.select("bucket", F.when(large, F.col("top.component")).alias("top"), F.ceil(tops / SLICE).cast("int").alias("tops"), F.ceil(rest / SLICE).cast("int").alias("rest"))
    own = placed.join(written(open_, "open"), "bucket").withColumn("in_top", F.coalesce(F.col("component") == F.col("top"), F.lit(False)))
    within = F.pmod(F.xxhash64("id", "bucket"), F.when(F.col("in_top"), F.col("tops")).otherwise(F.col("rest"))).cast("int")
    own = own.withColumn("slice", F.when(F.col("in_top"), F.col("rest") + within).otherwise(within))
    last = F.when(F.col("in_top"), F.col("rest")).otherwise(F.col("rest") + F.col("tops")) - 1
    own = own.join(reps.select("id", "bands"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    own = own.select("bucket", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "id", "n", "component", "bands")
    own = own.repartition(partitions(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    ddl = "bucket bigint, i int, j int, a array<bigint>, b array<bigint>"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, i, j), block in blocks(batches):
            slices, ids, n, component = (block.column(x).to_numpy() for x in range(3, 7))
            keys = block.column(7).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            left, right = np.flatnonzero(slices == i), np.flatnonzero(slices == j)
            low, high = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
            fit = (component[left][:, None] != component[right][None, :]) & (100 * low >= percent * high)
            if i == j:
                fit &= np.less.outer(left, right)
            if not fit.any():
                continue
            shared, here = np.zeros(fit.shape, np.int16), np.flatnonzero((keys == bucket).all(axis=0))
            for band in range(BANDS):
                same = keys[left, band][:, None] == keys[right, band][None, :]
                if len(here) and band < here[0]:
                    fit &= ~same  # an earlier bucket has this pair
                shared += same
            fit &= shared >= np.where(low >= BINS, SHARED, 1)
            x, y = np.nonzero(fit)
            if len(x):
                lists = [pa.array([ids[left[x]]], pa.list_(pa.int64())), pa.array([ids[right[y]]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([i], pa.int32()), pa.array([j], pa.int32()), *lists], names=["bucket", "i", "j", "a", "b"])

    return written(own.mapInArrow(pairs, ddl), "blocks")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Rows with equal first three columns, which follow each other, as one table; a block has at most a few hundred rows."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(x).to_numpy() for x in range(3)], axis=1)
        heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        for a, z in zip(heads, np.append(heads[1:], batch.num_rows), strict=True):
            own = tuple(keys[a].tolist())
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(a, z - a))
    if held:
        yield key, pa.Table.from_batches(held)


def common_sizes(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common elements of the sets ``a[k]`` and ``b[k]``; ``a`` rises."""
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    if len(sets) * len(values) > TABLE:
        return np.array([len(sets[x]) + len(sets[y]) - len(np.union1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)], np.int64)
    cuts = np.cumsum([0, *map(len, sets)])
    table = np.zeros((len(sets), len(values)), bool)
    table[np.repeat(np.arange(len(sets)), np.diff(cuts)), at] = True
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    out = [table[np.ix_(b[p:q], at[cuts[a[p]] : cuts[a[p] + 1]])].sum(axis=1) for p, q in zip(heads, np.append(heads[1:], len(a)), strict=True)]
    return np.concatenate(out)


def confirmed_in_blocks(found: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs of ``block_pairs`` whose full sets are similar enough, as ``a, b``."""
    spark, key = found.sparkSession, ["bucket", "i", "j"]
    members = found.select(*key, F.explode(F.array_distinct(F.concat("a", "b"))).alias("id")).join(texts, "id")
    none = F.lit(None)
    rows = members.select(*key, F.lit(0).alias("role"), "id", "text", none.cast("array<bigint>").alias("a"), none.cast("array<bigint>").alias("b"))
    rows = rows.unionByName(found.select(*key, F.lit(1).alias("role"), none.cast("bigint").alias("id"), none.cast("string").alias("text"), "a", "b"))
    rows = rows.repartition(partitions(spark), *key).sortWithinPartitions(*key, "role", "id")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in blocks(batches):
            ids = block.column(4)[:-1].to_numpy()
            sets = [shingles(t.as_py(), words) for t in block.column(5)[:-1]]
            a, b = (np.searchsorted(ids, block.column(x)[-1].values.to_numpy()) for x in (6, 7))
            by = np.argsort(a, kind="stable")
            a, b = a[by], b[by]
            sizes, common = np.array([len(x) for x in sets]), common_sizes(sets, a, b)
            linked = 100 * common >= percent * (sizes[a] + sizes[b] - common)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a[linked]]), pa.array(ids[b[linked]])], names=["a", "b"])

    return rows.mapInArrow(confirm, "a bigint, b bigint")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id``: one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    drawn = sketches(docs, words, id_col, text_col)
    nodes = drawn.filter("id IS NOT NULL AND n > 0")
    # several rows of one id, or one set: the smallest id stands for all
    classes = written(nodes.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    reps = nodes.join(classes.filter("last > rep").select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left").filter("rep IS NULL OR id = rep")
    reps = written(reps.select("id", "n", "bands"), "representatives")
    shared = shared_buckets(reps)
    scores = shared.groupBy("id").agg(F.sum("members").alias("score"))
    shared = written(shared.join(scores, "id").select("id", "n", "bucket", "score"), "buckets")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL")
    texts = written(near(texts, written(scores.select("id"), "candidates"), "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")

    links, seen, placed = None, None, shared.withColumn("component", F.col("id"))
    for turn in range(ROUNDS):
        # buckets within one component have nothing left to find
        centres = written(centres_of(placed, turn).filter("low < high").select("bucket", "centres"), "centres")
        useful = F.filter("centres", lambda c: (c["component"] != F.col("component")) & (100 * F.least(F.col("n"), c["n"]) >= percent * F.greatest(F.col("n"), c["n"])))
        stars = placed.join(centres, "bucket").select(F.col("id").alias("b"), useful.alias("centres")).filter(F.size("centres") > 0)
        edges = stars.select(F.explode(F.transform("centres", lambda c: c["id"])).alias("a"), "b").distinct()
        if seen is not None:
            edges = untried(edges, seen)
        edges = written(edges, "candidates")
        seen = edges if seen is None else seen.unionByName(edges)
        new = written(confirmed(edges, texts, words, percent), "confirmed")
        if turn and not new.limit(1).count():
            break
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        placed = placed_in(shared, labels)
    new = written(confirmed_in_blocks(block_pairs(placed, reps, percent), texts, words, percent), "last-confirmed")
    if new.limit(1).count():
        labels = components(links.unionByName(new))
    out = drawn.join(classes.filter("last > rep").select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    out = out.select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    out = out.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with their own columns."""
    dropped = near_groups(docs, words, percent, id_col, text_col).filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
