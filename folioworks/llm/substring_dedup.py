"""Exact substring deduplication with suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller id is removed.

1. Copies of a whole text need no search: all but the smallest id lose every
   byte if the text has ``length`` bytes; they leave the rest of the work.
2. A string of ``length`` bytes is dealt by the smallest hash of the
   ``GRAM``-byte grams inside it, so equal strings go to one bucket, and
   neighbouring strings of one bucket form a fragment of text.
3. The buckets of all documents are counted as packed hashes; those that two
   documents share are marked in a bit table of bounded size.  Only fragments of
   marked buckets go on.  A false mark costs work and changes nothing; the more
   buckets there are beyond the table's bound, the more marks are false, up to all.
4. The distinct fragments of a bucket meet in one task, each with the smallest
   id that has it.  A bucket with one fragment needs no search, as all its strings
   start first where the fragment does.  The others are sorted in blocks into a suffix array, and
   threshold-bounded interval expansion on the Burrows-Wheeler transform
   (breadth-first backward extension, which meets common prefixes by increasing
   length and stops at ``length``) leaves the runs of suffixes that share
   ``length`` bytes.  The smallest id of a run is where its string starts first.
   Fragments of a bucket over ``HOT_BYTES`` are passed on unsearched; their
   strings are dealt once more, each by itself, and Spark finds the smallest id.
5. Occurrences of fragments are joined to what was found for them, become byte
   spans, and are merged by document.

Null texts are empty; shorter texts lose nothing; rows with a null id are not
compared and lose nothing.  Rows that share an id must share the text: they get
the same result.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import mixed
from .repeats import MAX_TABLE_BITS, BitTables, near, repeated
from .store import partitions, small_batches, written

LENGTH, GRAM = 50, 20
#: Strings of one fragment, bytes of a block of fragments, bytes of packed hashes in a counting task.
RUN, BLOCK_BYTES, COUNT_BYTES = 128, 1_200_000, 64_000_000
FLUSH = 150_000
#: Bytes of one bucket's distinct fragments that a task searches.
HOT_BYTES = 4 * BLOCK_BYTES


def bucket_runs(text: bytes, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bucket, first, last`` of runs of string starts that fall in one bucket."""
    n = len(text) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    grams = len(data) - gram + 1

    def load(at: int) -> np.ndarray:  # eight bytes from each gram's byte `at` on
        return np.ndarray((grams,), "<u8", data, at, (1,))

    h = load(0) * np.uint64(0x9E3779B97F4A7C15)
    h += load(8) * np.uint64(0xC2B2AE3D27D4EB4F)
    h += load(gram - 8) * np.uint64(0xD6E8FEB86659FD93)
    h = mixed(h)
    width = length - gram + 1
    low, done = h, 1
    while done * 2 <= width:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    if done < width:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    if (last - first).max() >= RUN:  # texts that repeat themselves make long runs
        parts = (last - first) // RUN + 1
        at = np.repeat(np.arange(len(first)), parts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, end = first[at] + step * RUN, last[at]
        last = np.minimum(first + RUN - 1, end)
    return low[first], first, last


def sorting(key: np.ndarray, most: int) -> np.ndarray:
    """The order of non-negative keys up to ``most``; keys that leave room carry their place through a plain sort."""
    bits = max(1, len(key) - 1).bit_length()
    if most.bit_length() + bits > 63:
        return np.argsort(key)
    packed = key << bits | np.arange(len(key))
    packed.sort()
    return packed & ((1 << bits) - 1)


def suffix_order(codes: np.ndarray, length: int) -> np.ndarray:
    """Suffixes ordered by at least their first ``length`` symbols; zeros end fragments, and nothing behind them counts."""
    n, done = len(codes), 4
    ends = np.flatnonzero(codes == 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)  # symbols before the zero
    key, own, most = np.zeros(n, np.int64), np.empty(n, np.int64), 1 << 9 * done
    for j in range(done):
        own[: n - j] = codes[j:]
        own[n - j :] = 0
        key = key << 9 | np.where(left >= j, own, 0)
    while True:
        order = sorting(key, most)
        if done >= length:
            return order
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        then = np.zeros(n, np.int64)
        reach = np.flatnonzero(left >= done)
        then[reach] = rank[reach + done] + 1
        key, done, most = rank * (n + 1) + then, done * 2, (n + 1) ** 2


def boundaries(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at suffix ranks that share fewer than ``length`` symbols with the rank before.

    Interval expansion: the interval of a string ``w`` of ``m`` symbols gives the
    intervals of all ``cw``; where one ends at a rank with no common-prefix
    length yet, that length is ``m``, and ``cw`` is expanded in its turn.
    """
    n = len(codes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1  # position of the symbol before a suffix; the first wraps to the last zero
    transform = codes[before]
    step = place[before]  # the rank of the suffix that starts there
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    sizes = np.bincount(codes)
    lows = np.cumsum(sizes) - sizes
    zeros = int(sizes[0])
    own = np.flatnonzero(sizes[1:]) + 1
    # the empty string: one interval for each symbol, one for each fragment end
    low, high = np.concatenate([np.arange(zeros), lows[own]]), np.concatenate([np.arange(zeros), lows[own] + sizes[own] - 1])
    known[high + 1] = True
    for _ in range(1, length):
        if not len(low):
            break
        widths = high - low + 1
        total = int(widths.sum())
        which = np.repeat(np.arange(len(low)), widths)
        ranks = np.arange(total) - np.repeat(np.cumsum(widths) - widths, widths) + low[which]
        symbols = transform[ranks]
        keep = symbols > 0
        to, which, symbols = step[ranks[keep]], which[keep], symbols[keep]
        if not len(to):
            break
        by = sorting(to, n)
        to, which, symbols = to[by], which[by], symbols[by]
        start = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (symbols[1:] != symbols[:-1]) | (np.diff(to) != 1)]))
        low, high = to[start], to[np.concatenate([start[1:], [len(to)]]) - 1]
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    return known[:n]


def first_ids(fragments: list[bytes], ids: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For every string start of every fragment, one after the other: the fragment's number, and the smallest id among the fragments that hold the string."""
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    codes = np.zeros(int(sizes.sum()) + len(fragments), np.int64)
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    codes[inside] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64) + 1
    order = suffix_order(codes, length)
    heads = np.flatnonzero(boundaries(codes, order, length))
    least = np.minimum.reduceat(ids[owner[order]], heads)
    found = np.empty(len(codes), np.int64)
    found[order] = np.repeat(least, np.diff(np.concatenate([heads, [len(codes)]])))
    starts = np.flatnonzero(ends[owner] - np.arange(len(codes)) >= length)
    return owner[starts], found[starts]


def runs_of(prints: list[bytes], ids: np.ndarray, many: np.ndarray, owner: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """Runs of equal ``found`` in each fragment, for fragments of several documents or with an earlier one."""
    heads = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    earliest = np.minimum.reduceat(found, heads)
    wanted = many | (earliest < ids)
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(found) != 0)]))
    after = np.concatenate([cuts[1:], [len(owner)]])
    keep = wanted[owner[cuts]]
    cuts, after = cuts[keep], after[keep]
    base = heads[owner[cuts]]
    fields = [pa.array((cuts - base).astype(np.int32)), pa.array((after - 1 - base).astype(np.int32)), pa.array(found[cuts])]
    runs = pa.StructArray.from_arrays(fields, names=["first", "last", "least"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[cuts], minlength=len(ids))[wanted])])
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), runs)
    return pa.RecordBatch.from_arrays([pa.array([prints[i] for i in np.flatnonzero(wanted)], pa.binary()), lists], names=["print", "runs"])


def shared_table(texts: DataFrame, length: int, bits: int, chunks: int) -> BitTables:
    """Bit tables of the buckets that at least two documents have."""

    def buckets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for text in batch.column(1):
            yield np.unique(bucket_runs(text.as_py().encode("utf-8", "surrogatepass"), length)[0])

    return repeated(texts, buckets_of, bits, chunks)


def fragments_of(texts: DataFrame, length: int, table: BitTables) -> DataFrame:
    """Rows of two kinds: occurrences ``print, id, start``; distinct fragments of a task ``id, bucket, many, body``, whose print follows from the body.

    ``id`` of a fragment is the smallest that the task has seen, ``many`` whether it saw another.
    """
    spread = texts.sparkSession.sparkContext.broadcast(table)  # at most MAX_TABLE_BITS bits
    names = ["print", "id", "start", "bucket", "many", "body"]
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = spread.value
        seen: dict[bytes, list] = {}
        prints: list[bytes] = []
        ids: list[int] = []
        starts: list[int] = []

        def occurrences() -> pa.RecordBatch:
            n = len(prints)
            columns = [prints, ids, starts, [None] * n, [None] * n, [None] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def bodies() -> pa.RecordBatch:
            rows = [(None, i, None, b, m, body) for body, (_, i, b, m) in seen.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                buckets, first, last = bucket_runs(data, length)
                keep = marks.marked(buckets)
                for b, a, z in zip(buckets[keep].astype(np.int64).tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
                    body = data[a : z + length]
                    own = seen.get(body)
                    if own is None:
                        own = seen[body] = [print_of(body), doc, b, False]
                    elif own[1] != doc:
                        own[1], own[3] = min(own[1], doc), True
                    prints.append(own[0])
                    ids.append(doc)
                    starts.append(a)
                if len(prints) > FLUSH:
                    yield occurrences()
                    prints, ids, starts = [], [], []
                if len(seen) > FLUSH:
                    yield bodies()
                    seen = {}
        if prints:
            yield occurrences()
        if seen:
            yield bodies()

    return texts.mapInArrow(cut, "print binary, id bigint, start int, bucket bigint, many boolean, body binary")


def print_of(body: bytes) -> bytes:
    """What stands for a fragment: 96 bits of its hash."""
    return xxhash.xxh3_128_digest(body)[:12]


RUNS = "runs array<struct<first:int,last:int,least:bigint>>"
HOT = "id bigint, many boolean, body binary"


def found_in(bodies: DataFrame, length: int) -> DataFrame:
    """Written rows ``print, runs``: runs of a fragment's string starts with the smallest id that has their strings; fragments of one document alone are left out."""
    size = bodies.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(partitions(bodies.sparkSession), -(-size // (4 * BLOCK_BYTES)))
    most = HOT_BYTES
    kinds = [pa.binary(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("least", pa.int64())])), pa.int64(), pa.bool_(), pa.binary()]
    names = ["print", "runs", "id", "many", "body"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, bucket = 0, None
        # of the bucket: fragments held before it and their bytes, and whether it goes on unsearched
        before, size_before, hot = 0, 0, False
        single: list[tuple[bytes, int, bytes]] = []

        def ended() -> None:
            """Takes the only fragment of a bucket out of the search; nothing is found for one that one document has."""
            nonlocal size
            if len(held) == before + 1:
                body, (doc, many) = held.popitem()
                size -= len(body)
                if many:
                    single.append((print_of(body), doc, body))

        def block() -> pa.RecordBatch:
            prints, (ids, many) = [print_of(body) for body in held], zip(*held.values(), strict=True)
            ids = np.array(ids)
            prints, runs = runs_of(prints, ids, np.array(many), *first_ids(list(held), ids, length)).columns
            return pa.RecordBatch.from_arrays([prints, runs.cast(kinds[1]), *(pa.nulls(len(prints), k) for k in kinds[2:])], names=names)

        def alone() -> pa.RecordBatch:
            n = len(single)
            runs = [[{"first": 0, "last": len(body) - length, "least": doc}] for _, doc, body in single]
            return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in single], pa.binary()), pa.array(runs, kinds[1]), *(pa.nulls(n, k) for k in kinds[2:])], names=names)

        def unsearched(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*((print_of(body), None, doc, many, body) for doc, many, body in rows), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            passed = []
            for doc, b, many, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b != bucket:
                    ended()
                    if size > BLOCK_BYTES:
                        yield block()
                        held, size = {}, 0
                    if len(single) > FLUSH:
                        yield alone()
                        single = []
                    bucket, before, size_before, hot = b, len(held), size, False
                if hot:
                    passed.append((doc, many, body))
                    continue
                own = held.get(body)
                if own is None:
                    held[body] = [doc, many]
                    size += len(body)
                else:
                    own[1] = own[1] or many or own[0] != doc
                    own[0] = min(own[0], doc)
                if size - size_before > most:
                    hot = True
                    for other in list(held)[before:]:
                        passed.append((*held.pop(other), other))
                    size = size_before
            if passed:
                yield unsearched(passed)
        ended()
        if held:
            yield block()
        if single:
            yield alone()

    rows = bodies.select("id", "bucket", "many", "body").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = written(rows.mapInArrow(search, f"print binary, {RUNS}, {HOT}"), "found")
    searched = found.filter("runs IS NOT NULL").select("print", "runs")
    hot = found.filter("runs IS NULL")
    if not hot.limit(1).count():
        return searched
    return searched.unionByName(written(found_by_string(hot, length), "found-by-string"))


def found_by_string(hot: DataFrame, length: int) -> DataFrame:
    """``print, runs`` of fragments ``print, id, many, body``: each string is a run; popular strings are aggregated before they are shuffled."""
    many = F.max("many") | (F.min("id") < F.max("id"))
    whole = written(hot.groupBy("print").agg(F.min("id").alias("id"), many.alias("many"), F.first("body").alias("body")), "hot")
    at = F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("at")
    strings = whole.select("print", "id", "many", "body", at).select("print", "id", "many", "at", F.expr(f"substring(body, at + 1, {length})").alias("string"))
    least = strings.groupBy("string").agg(F.min("id").alias("least"))
    runs = strings.join(least, "string").filter("many OR least < id")
    one = F.struct(F.col("at").cast("int").alias("first"), F.col("at").cast("int").alias("last"), "least")
    return runs.groupBy("print").agg(F.collect_list(one).alias("runs"))


def removed_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Written rows ``id, spans``: byte spans (not yet merged) to remove, of ``texts(id, text)`` with distinct texts."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = 1 << 16
    while bits < size // 3 and bits < MAX_TABLE_BITS:
        bits *= 2
    chunks = 1
    while chunks < 16 or chunks * COUNT_BYTES < size:
        chunks *= 2
    rows = written(fragments_of(texts, length, shared_table(texts, length, bits, chunks)), "fragments", compression="zstd")
    found = found_in(rows.filter("body IS NOT NULL"), length)
    hits = rows.filter("body IS NULL").select("print", "id", "start").join(found, "print")
    hits = hits.select("id", "start", F.explode("runs").alias("r")).filter(F.col("r.least") < F.col("id"))
    spans = hits.select("id", (F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last") + length).alias("end"))
    return written(spans.groupBy("id").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")


def merged(spans: list[dict[str, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted((s["first"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def kept_bytes(data: bytes, spans: list[list[int]]) -> bytes:
    out, at = [], 0
    for a, z in spans:
        out.append(data[at:a])
        at = z
    return b"".join([*out, data[at:]])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and the ``kept`` bytes): one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    slim = written(rows.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "texts")
    firsts = slim.filter("id IS NOT NULL").groupBy("sha", "n").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("last > first")
    firsts = written(firsts.select("sha", "first"), "copied")
    copies = written(slim.filter("id IS NOT NULL").join(firsts, "sha").filter("id > first").select("id").distinct(), "copies")
    texts = near(rows.filter(f"id IS NOT NULL AND octet_length(text) >= {length}"), copies, "id", "left_anti")
    if repeats(slim):
        texts = texts.dropDuplicates(["id"])
    spans = removed_spans(texts, length)
    ids = written(spans.select("id"), "touched")

    whole = slim
    if with_kept:
        whole = rows.select("id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("kept"))
    extra = ["kept"] * with_kept
    plain = near(near(whole, copies, "id", "left_anti"), ids, "id", "left_anti")
    gone = near(whole, copies, "id", "left_semi")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    removed = F.when(F.col("n") >= length, F.col("n")).otherwise(0).cast("long")
    out = plain.select("id", "n", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *extra)
    copied = gone.select("id", "n", removed.alias("n_removed"), (removed > 0).cast("long").alias("n_spans"), F.when(removed > 0, empty).otherwise(F.col("sha")).alias("kept_sha256"), *extra)
    if with_kept:
        copied = copied.withColumn("kept", F.when(F.col("n_removed") > 0, F.lit(b"")).otherwise(F.col("kept")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {k: [] for k in ("id", "n", "n_removed", "n_spans", "kept_sha256", "kept")}
            for doc, body, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data, spans = body.as_py().encode("utf-8", "surrogatepass"), merged(own.as_py())
                kept = kept_bytes(data, spans)
                for c, v in zip(columns.values(), (doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept if with_kept else None), strict=True):
                    c.append(v)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns.values(), kinds, strict=True)], names=list(columns))

    touched = near(rows, ids, "id", "left_semi").join(spans, "id").select("id", "text", "spans")
    touched = touched.mapInArrow(cut, "id bigint, n bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    if not with_kept:
        touched = touched.drop("kept")
    return out.unionByName(copied).unionByName(touched).withColumnRenamed("id", id_col).withColumnRenamed("n", "n_bytes")


def repeats(slim: DataFrame) -> bool:
    """Whether some id has several rows."""
    return bool(slim.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count())
