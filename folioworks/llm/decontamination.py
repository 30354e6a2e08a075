"""Benchmark decontamination by a generalised suffix automaton of the test items.

The automaton holds every run of words of every item.  A document's words are
streamed through it; after each word its state gives the longest run that ends
there and occurs in an item.  Where that run has ``window`` words, all of it is
inside occurrences of windows, and the state's ancestor of that length names
the items.  An item shorter than the window (but not empty) is one window of
its own length, found on the chain of suffix links.

Word pairs that no item has end every match, so only stretches of words whose
neighbours are pairs of some item are streamed; a hashed table of the pairs
finds the stretches with numpy (false pairs only make stretches longer).

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Null and
empty texts have no words; null or repeated item ids are taken as they are (a
null id is named "null"), empty benchmarks hit nothing.

Items of at most ``BLOCK_BYTES`` have one automaton that every task streams its
texts through.  More items are dealt to blocks of about that size and never meet
in one place: a bit table of the items' windows finds the stretches of a text
that can hold one, stretches are joined to the blocks that have their windows,
and each block's automaton is built in the tasks that its stretches are dealt to.
The blocks' findings are merged by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import mixed, word_hashes
from .store import partitions, small_batches, written
from .worker import release

WINDOW = 10
BLOCK_BYTES = 1 << 20
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 32 for b in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
PAIR_BITS = 22
#: Bits of the window table of many items at most, bits of one of its rows, and stretches that one task takes for a block.
MAX_TABLE_BITS, BITMAP, DEALT = 1 << 27, 1 << 15, 20_000
FOUND = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Vocabulary(dict):
    """Words to numbers; unknown words are -1 and are not remembered."""

    def __missing__(self, word: bytes) -> int:
        return -1


class ItemAutomaton:
    """A generalised suffix automaton of the items' words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary = Vocabulary()
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = min((min(window, len(words)) for _, words in coded), default=0)
        self._name(coded)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, words in coded:
            codes = np.array(words, np.int64)
            self.pairs[self._pair(codes)] = True

    @staticmethod
    def _pair(codes: np.ndarray) -> np.ndarray:
        mixed = (codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return mixed >> np.uint64(64 - PAIR_BITS)

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings of ``q`` no longer than ``p`` and ``w``."""
        new = self._state(dict(self.step[q]), self.link[q], self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, w: int) -> int:
        there = self.step[last].get(w)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, w, there)
        new, p = self._state({}, 0, self.length[last] + 1), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _name(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which items the windows at each state belong to."""
        order = sorted(range(len(self.step)), key=self.length.__getitem__)
        self.at = [-1] * len(order)  # the ancestor that holds the state's last `window` words
        for v in order[1:]:
            up = self.link[v]
            if self.length[v] >= self.window:
                self.at[v] = v if self.length[up] < self.window else self.at[up]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, words in coded:
            v = 0
            for i, w in enumerate(words, 1):
                v = self.step[v][w]
                if i >= self.window:
                    self.items.setdefault(self.at[v], set()).add(name)
            if len(words) < self.window:
                self.short.setdefault(v, []).append((len(words), name))
        self.chain: dict[int, list[tuple[int, str]]] = {}
        if self.short:
            for v in order[1:]:
                if both := self.short.get(v, []) + self.chain.get(self.link[v], []):
                    self.chain[v] = both

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans inside occurrences of windows, merged, and the items of those windows."""
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        if not self.least or len(words) < self.least:
            return spans, names
        codes = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        known = codes >= 0
        joined = np.zeros(len(codes) + 1, bool)
        if len(codes) > 1:
            joined[1:-1] = known[1:] & known[:-1] & self.pairs[self._pair(codes)]
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        wide = ends - starts >= self.least
        for a, b in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            self._stream(codes[a:b].tolist(), a, spans, names)
        return spans, names

    def _stream(self, codes: list[int], first: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        v, n = 0, 0
        for i, w in enumerate(codes, first):
            while v and w not in self.step[v]:
                v = self.link[v]
                n = self.length[v]
            if w in self.step[v]:
                v, n = self.step[v][w], n + 1
            longest = 0
            if n >= self.window:
                longest = n
                # the ancestor of the matched run, which may be shorter than its state's longest string
                names |= self.items[self.at[v]]
            for m, name in self.chain.get(v, ()):
                if m <= n:
                    names.add(name)
                    longest = max(longest, m)
            if longest:
                a = i + 1 - longest
                while spans and spans[-1][1] + 1 >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i))


def window_hashes(words: list[bytes], m: int) -> np.ndarray:
    """Signed 64-bit hashes of all runs of ``m`` words."""
    n = len(words) - m + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    codes, out = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words)), np.full(n, m, np.uint64)
    for i in range(m):
        out = mixed(out + codes[i : i + n])
    return out.view(np.int64)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Written ``m, h, block``: lengths and hashes of the windows of ``items(id, text, block)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, block in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = words_of(text.as_py())
                m = min(window, len(words))
                own = np.unique(window_hashes(words, m)) if m else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([m] * len(own), pa.int32()), pa.array(own), pa.array([block] * len(own), pa.int64())], names=["m", "h", "block"])

    return written(items.select("text", "block").mapInArrow(cut, "m int, h bigint, block bigint").distinct(), "windows")


def stretches_of(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """Written ``key, n_words, runs``: by ``texts(key, text)`` the stretches of words that may hold a window: first word, words and window hashes."""
    bits = BITMAP
    while bits < 32 * windows.count() and bits < MAX_TABLE_BITS:
        bits *= 2
    lengths = sorted(r["m"] for r in windows.select("m").distinct().collect())  # at most the window
    at = F.pmod("h", F.lit(bits))
    rows = windows.select(at.alias("at")).groupBy(F.expr(f"at div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # MAX_TABLE_BITS at most
        table[r["part"] * BITMAP // 8 : (r["part"] + 1) * BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    spread = texts.sparkSession.sparkContext.broadcast(table)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = spread.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.string()), ("windows", pa.list_(pa.int64()))]))
        for batch in batches:
            sizes, runs = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                inside, hits = np.zeros(len(words) + 1, np.int64), []
                for m in lengths:
                    own = window_hashes(words, m)
                    place = own % bits
                    found = np.flatnonzero(marks[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                    np.add.at(inside, found, 1)
                    np.add.at(inside, found + m, -1)
                    hits += zip(found.tolist(), own[found].tolist(), strict=True)
                covered = np.concatenate([[False], np.cumsum(inside)[:-1] > 0, [False]])
                edges = np.flatnonzero(covered[1:] != covered[:-1]).tolist()
                own = [{"first": a, "words": b" ".join(words[a:z]).decode("utf-8", "surrogatepass"), "windows": sorted({h for i, h in hits if a <= i < z})} for a, z in zip(edges[::2], edges[1::2], strict=True)]
                sizes.append(len(words))
                runs.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind)], names=["key", "n_words", "runs"])

    return written(texts.mapInArrow(mark, "key string, n_words bigint, runs array<struct<first:bigint,words:string,windows:array<bigint>>>"), "stretches")


def found_in_blocks(stretches: DataFrame, windows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``key, spans, items`` of the texts with findings; a block's stretches are dealt over as many tasks as they need."""
    spark = stretches.sparkSession
    runs = stretches.dropDuplicates(["key"]).select("key", F.explode("runs").alias("r")).select("key", "r.first", "r.words", F.explode("r.windows").alias("h"))
    pairs = written(runs.join(windows.select("h", "block"), "h").groupBy("block", "key", "first").agg(F.first("words").alias("words")), "pairs")
    parts = written(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")), "parts")
    part = F.pmod(F.xxhash64("key", "first"), F.col("parts")).cast("int").alias("part")
    asked = pairs.join(parts, "block").select("block", part, F.lit(1).alias("role"), "key", "first", F.col("words").alias("text"))
    own = items.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("id").alias("key"), F.lit(0).cast("long").alias("first"), "text")
    rows = own.unionByName(asked).repartition(partitions(spark), "block", "part").sortWithinPartitions("block", "part", "role")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, automaton, held = None, None, []
        kinds = [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
        for batch in batches:
            out = []
            for block, part, role, key, first, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (block, part) != place:
                    place, automaton, held = (block, part), None, []
                if role == 0:
                    held.append((key, words_of(text)))
                    continue
                automaton = automaton or ItemAutomaton(held, window)
                spans, names = automaton.find(words_of(text))
                if spans:
                    out.append((key, [{"first": a + first, "last": b + first} for a, b in spans], sorted(names)))
            columns = zip(*out, strict=True) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "spans", "items"])

    found = rows.mapInArrow(find, "key string, spans array<struct<first:bigint,last:bigint>>, items array<string>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _finder(items: list[tuple[str, list[bytes]]], window: int):
    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        automaton = ItemAutomaton(items, window)
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text.as_py())
                spans, names = automaton.find(words)
                out.append({"n_words": len(words), "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted(names)})
            yield pa.array(out, kind)

    return find


def _merged(spans: Column) -> Column:
    """Union of word spans given in any order."""
    empty = F.expr("array(struct(bigint(0) AS first, bigint(0) AS last))").getItem(0)
    step = lambda done, x: F.when(
        (F.size(done) > 0) & (F.element_at(done, -1)["last"] + 1 >= x["first"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last")))),
    ).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array_except(F.array(empty), F.array(empty)), step)


def few_items(items: DataFrame) -> list[tuple[str, list[bytes]]] | None:
    """The items if they have at most ``BLOCK_BYTES``, so that they may pass through the driver."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return [(r["id"], words_of(r["text"])) for r in items.filter("text <> ''").collect()] if size <= BLOCK_BYTES else None


def named_items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))


def find_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, out_col: str = "found") -> DataFrame:
    """``docs`` with a column ``found``: ``n_words``, merged hit ``spans`` of word numbers, sorted ``items``."""
    if out_col in docs.columns:
        raise ValueError(f"column {out_col} is already there")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    items = named_items(benchmark, item_col, item_text)
    if (few := few_items(items)) is not None:
        return docs.withColumn(out_col, _finder(few, window)(text))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    items = written(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(-(-size // BLOCK_BYTES)))), "items")
    windows = item_windows(items, window)
    key = F.sha2(text, 256)
    stretches = stretches_of(docs.select(key.alias("key"), text.alias("text")), windows)
    found = written(found_in_blocks(stretches, windows, items, window), "found")
    # rows of one text have one finding; most texts have none
    sizes = stretches.groupBy("key").agg(F.first("n_words").alias("n_words"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key")).join(sizes, "key").join(found, "key", "left")
    none = F.from_json(F.lit("[]"), "array<struct<first:bigint,last:bigint>>")
    merged = F.when(F.col("spans").isNull(), none).otherwise(_merged(F.col("spans")))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select("row.*", F.struct("n_words", merged.alias("spans"), names.alias("items")).alias(out_col))


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b][1]
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_words: int = WINDOW, max_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """``docs`` cleaned: spans of ``min_words`` hit words or more are cut out of the text, and spans that hold a whole shorter item.

    A document of which more than ``max_coverage`` of the words are hit is
    removed.  Documents without hits keep their rows as they are.
    """
    small_batches(docs.sparkSession)
    # the row travels as one column, so that its names cannot clash
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct("*").alias("row"))
    if (few := few_items(named_items(benchmark, "item_id", "text"))) is not None:
        rows = rows.withColumn("clean", _cleaner(few, window, min_words, max_coverage)(F.coalesce("text", F.lit(""))))
        rows = rows.filter("clean.kept").withColumn("cleaned", F.coalesce("clean.text", "text"))
    else:
        rows = _cleaned(rows, benchmark, min_words, max_coverage, window)
    return rows.select(*(F.col("cleaned").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def _cleaner(items: list[tuple[str, list[bytes]]], window: int, min_words: int, max_coverage: float):
    """Finds and cuts in one function, so that a task needs one Python worker: ``kept``, and the ``text`` if it changed."""

    @F.arrow_udf("struct<kept:boolean,text:string>")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        automaton = ItemAutomaton(items, window)
        wide = ItemAutomaton(items, min_words) if min_words > window else None
        for texts in batches:
            kept, out = [], []
            for x in texts:
                text = x.as_py()
                words = words_of(text)
                spans, _ = automaton.find(words)
                kept.append(sum(b - a + 1 for a, b in spans) <= max_coverage * len(words))
                if spans and wide:
                    whole, _ = wide.find(words)
                    spans = [(a, b) for a, b in spans if b - a + 1 >= min_words or any(a <= c and d <= b for c, d in whole)]
                out.append(cut_spans(text, spans) if spans and kept[-1] else None)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.bool_()), pa.array(out, pa.string())], names=["kept", "text"])

    return clean


def _cleaned(rows: DataFrame, benchmark: DataFrame, min_words: int, max_coverage: float, window: int) -> DataFrame:
    """The kept ``rows(text, row)`` with ``cleaned``, by items in blocks."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        parts = zip(texts.to_pylist(), firsts.to_pylist(), lasts.to_pylist(), strict=True)
        return pa.array([text if not a else cut_spans(text, list(zip(a, b, strict=True))) for text, a, b in parts], pa.string())

    out = find_items(rows, benchmark, window=window)
    if min_words <= window:  # a shorter span can only be of whole items that are as short
        long = F.col("found")["spans"]
    else:
        # hits of this width are whole shorter items, or long enough by themselves
        out = find_items(out, benchmark, window=min_words, out_col="whole")
        holds = lambda x: F.exists(F.col("whole")["spans"], lambda y: (x["first"] <= y["first"]) & (y["last"] <= x["last"]))
        long = F.filter(F.col("found")["spans"], lambda x: (x["last"] - x["first"] + 1 >= min_words) | holds(x))
    kept = out.filter(hit_words(F.col("found")) <= F.lit(max_coverage) * F.col("found")["n_words"]).withColumn("long", long)
    return kept.withColumn("cleaned", F.when(F.size("long") > 0, cut("text", F.transform("long", lambda x: x["first"]), F.transform("long", lambda x: x["last"]))).otherwise(F.col("text")))
