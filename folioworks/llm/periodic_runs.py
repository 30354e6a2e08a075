"""Runs of periodic words, found by internal pattern matching.

The words of a few texts are named by numbers that no other text has, so
nothing matches across texts, and taken as one string:

1. Prefix doubling gives the suffix array and, for every power of two, the
   interval of suffixes that begin with the same block of so many words.
2. Every aligned dyadic block asks for its next and its last occurrence in the
   window of its own length on either side: range successor in a wavelet tree
   over its interval of the suffix array.  A run of period ``q`` with four
   periods and more holds an aligned block of ``q`` to ``2 q - 1`` words whose
   neighbouring occurrence on one side lies in the run, so it lies ``q`` away:
   occurrences inside a run form a progression of that difference.
3. Each difference is a candidate period, extended to both sides by the names
   of dyadic blocks.  Stretches that are long enough are runs; of the periods of
   one stretch the smallest counts.

Words are ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch with smallest period q of
at least ``max(shortest, exponent * q)`` words that no neighbouring word extends.
A word is dropped if a run holds it after that run's first q words.  Null and
empty texts have no words and no runs; a null id is kept.  Rows are independent:
repeated rows give the same result, an empty table gives none.  A text is held
whole with some 200 bytes a word in its task; texts are gathered up to ``WORDS``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: Words that are searched together, unless one text has more.
WORDS = 1 << 16


class Blocks:
    """Names of all dyadic blocks of a string, and the suffix array.

    ``names[k][i]`` is where the suffixes that begin like ``i`` for ``2 ** k``
    words start in the suffix array; ``repeats[k]`` holds the positions whose
    block is not alone, and ``sizes[k]`` how many have it.
    """

    def __init__(self, codes: np.ndarray) -> None:
        n = len(codes)
        self.order = np.argsort(codes, kind="stable").astype(np.int32)
        heads = np.concatenate([[True], np.diff(codes[self.order]) != 0])
        first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        name = np.empty(n, np.int32)
        name[self.order] = first
        sizes = np.diff(np.append(np.flatnonzero(heads), n))[np.cumsum(heads) - 1]
        self.names, self.repeats, self.sizes = [name], [self.order[sizes > 1]], [sizes[sizes > 1]]
        width = 1
        while len(self.repeats[-1]):
            at = self.repeats[-1].astype(np.int64)
            old = self.names[-1]
            beyond = np.where(at + width < n, old[np.minimum(at + width, n - 1)], -1)
            key = old[at].astype(np.int64) * (n + 1) + beyond + 1
            by = np.argsort(key)
            at, key = at[by], key[by]
            own, index = old[at], np.arange(len(at))
            group = np.concatenate([[True], np.diff(own) != 0])
            place = own + index - np.maximum.accumulate(np.where(group, index, 0))
            self.order[place] = at
            heads = np.concatenate([[True], np.diff(key) != 0])
            name = old.copy()
            name[at] = place[heads][np.cumsum(heads) - 1]
            sizes = np.diff(np.append(np.flatnonzero(heads), len(at)))[np.cumsum(heads) - 1]
            self.names.append(name)
            self.repeats.append(at[sizes > 1].astype(np.int32))
            self.sizes.append(sizes[sizes > 1])
            width *= 2

    def common_after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that follow alike from ``i`` and ``j``, ``i < j``."""
        n, i, j = len(self.order), i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = (j + (1 << k) <= n) & (self.names[k][np.minimum(i, n - 1)] == self.names[k][np.minimum(j, n - 1)])
            i += same << k
            j += same << k
        return i - start

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            same = (a >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])
            i -= same << k
            j -= same << k
        return start - i


class WaveletTree:
    """Ranks and order statistics of any stretch of an array, one bit of its values at a level."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(int(max(1, len(values) - 1)).bit_length() - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros_before = np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32)
            self.levels.append((bit, zeros_before, int(zeros_before[-1])))
            values = np.concatenate([values[~ones], values[ones]])

    def smaller(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in ``[low, high)`` are below ``value``."""
        out = np.zeros(len(low), np.int64)
        for bit, zeros_before, zeros in self.levels:
            a, b = zeros_before[low], zeros_before[high]
            one = (value >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return out

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The n-th smallest value (from 0) in ``[low, high)``."""
        out = np.zeros(len(low), np.int64)
        for bit, zeros_before, zeros in self.levels:
            a, b = zeros_before[low], zeros_before[high]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            out |= one.astype(np.int64) << bit
            low, high = np.where(one, zeros + low - a, a), np.where(one, zeros + high - b, b)
        return out


def candidates(codes: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """Positions and differences ``(x, d)``: the words at x and x + d belong to a block and its neighbour."""
    # the windows of a block of one word are the words beside it
    same = np.flatnonzero(codes[1:] == codes[:-1])
    same = same[np.concatenate([[True], np.diff(same) > 1])] if len(same) else same
    found = [(same, np.ones(len(same), np.int64))]
    parts = []
    for k in range(1, len(blocks.names)):
        at = blocks.repeats[k].astype(np.int64)
        aligned = (at & (1 << k) - 1) == 0
        low = blocks.names[k][at[aligned]].astype(np.int64)
        parts.append((at[aligned], low, low + blocks.sizes[k][aligned], np.full(int(aligned.sum()), 1 << k)))
    if parts and sum(len(p[0]) for p in parts):
        at, low, high, width = (np.concatenate(p) for p in zip(*parts, strict=True))
        tree = WaveletTree(blocks.order)
        before = tree.smaller(low, high, at)
        for step in (1, -1):
            some = np.flatnonzero(before + 1 < high - low if step > 0 else before > 0)
            there = tree.nth(low[some], high[some], before[some] + step)
            d = np.abs(there - at[some])
            near = d <= width[some]
            found.append((np.minimum(there, at[some])[near], d[near]))
    return np.concatenate([f[0] for f in found]).astype(np.int64), np.concatenate([f[1] for f in found]).astype(np.int64)


def runs_of(codes: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of all runs, by start, then period."""
    if len(codes) < 2:
        return (np.zeros(0, np.int64),) * 3
    blocks = Blocks(codes)
    x, d = candidates(codes, blocks)
    start, end = x - blocks.common_before(x, x + d), x + d + blocks.common_after(x, x + d)
    long = end - start >= np.maximum(shortest, exponent * d)
    start, end, d = start[long], end[long], d[long]
    by = np.lexsort((d, end, start))
    start, end, d = start[by], end[by], d[by]
    first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) if len(d) else np.zeros(0, bool)
    start, end, d = start[first], end[first], d[first]
    by = np.lexsort((d, start))
    return start[by], end[by], d[by]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, exponent: int = 4, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``id_col, n_words, runs, collapsed``: a text's runs (start, length, period, by start) and its kept words joined by one space.

    ``edit`` may change the words of a row before they are searched.
    """
    if exponent < 4:
        raise ValueError("a run needs four periods at least: shorter ones may hold no block whose neighbour tells the period")
    small_batches(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def searched(rows: list[tuple[object, list[bytes]]], kind: pa.DataType) -> pa.RecordBatch:
        codes, sizes, base = [], [], 0
        for _, words in rows:
            named: dict[bytes, int] = {}
            codes.append(np.array([named.setdefault(w, len(named)) for w in words], np.int64) + base)
            sizes.append(len(words))
            base += len(named)
        ends = np.cumsum(sizes)
        start, end, period = runs_of(np.concatenate(codes), shortest, exponent)
        cuts = np.searchsorted(start, np.concatenate([[0], ends]))
        runs, kept = [], []
        for i, (_, words) in enumerate(rows):
            own, first = slice(cuts[i], cuts[i + 1]), ends[i] - sizes[i]
            runs.append([{"start": s - first, "length": e - s, "period": q} for s, e, q in zip(start[own].tolist(), end[own].tolist(), period[own].tolist(), strict=True)])
            if runs[-1]:
                drop = np.zeros(len(words), bool)
                for r in runs[-1]:
                    drop[r["start"] + r["period"] : r["start"] + r["length"]] = True
                words = [words[j] for j in np.flatnonzero(~drop).tolist()]
            kept.append(b" ".join(words))
        arrays = [pa.array([i for i, _ in rows], kind), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_words", "runs", "collapsed"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[object, list[bytes]]] = []
        size = 0
        for batch in batches:
            kind = batch.column(0).type
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").split()
                rows.append((ident, edit(ident, words) if edit else words))
                size += len(rows[-1][1])
                if size >= WORDS:
                    yield searched(rows, kind)
                    rows, size = [], 0
        if rows:
            yield searched(rows, kind)

    own = docs.select(id_col, F.col(text_col).cast("binary").alias("text"))
    ddl = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return own.mapInArrow(search, ddl).withColumn("collapsed", F.col("collapsed").cast("string"))
