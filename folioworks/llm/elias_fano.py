"""Monotone sequences in Elias-Fano form, and files of arrays that are mapped into memory.

A value's low bits are packed side by side, its high part is told by a zero for
every step of it in a bit string with a one for every value.  A rank directory
(ones before each 64 bits) finds the n-th one or zero, so single values and
successors are looked up without decoding.  All calls take arrays of queries.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Place of the n-th one in a byte.
PLACES = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)
LONGEST = 56


def packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` of each value, side by side, and some spare bytes."""
    parts = []
    for i in range(0, len(values) if bits else 0, 1 << 16):
        chunk = np.ascontiguousarray(values[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(chunk, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little"))
    return np.concatenate([*parts, np.zeros(16, np.uint8)])


class EliasFano:
    """A rising sequence of unsigned 64-bit numbers; equal ones are allowed."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        n, bits = arrays[f"{name}.size"].tolist()
        self.n, self.bits = n, bits
        self.low, self.high, self.before = arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.before"]

    @staticmethod
    def arrays(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        """The arrays that hold a sequence."""
        values, n = values.astype(np.uint64), len(values)
        top = int(values[-1]) if n else 0
        bits = min(LONGEST, max(0, (top // max(1, n)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros(-(-(n + (top >> bits) + 2) // 64) * 64, bool)
        flags[high + np.arange(n)] = True
        ones = np.cumsum(np.concatenate([[0], flags.reshape(-1, 64).sum(axis=1)])).astype(np.int64)
        return {f"{name}.size": np.array([n, bits], np.int64), f"{name}.low": packed(values, bits), f"{name}.high": np.packbits(flags, bitorder="little"), f"{name}.before": ones}

    def _in_word(self, word: np.ndarray, n: np.ndarray, flip: bool) -> np.ndarray:
        """Place in the string of the n-th one (or zero, with ``flip``) of these 64 bits."""
        own = self.high.reshape(-1, 8)[word]
        if flip:
            own = ~own
        upto = np.cumsum(np.bitwise_count(own), axis=1, dtype=np.uint8)
        byte = (upto <= n.astype(np.uint8)[:, None]).sum(axis=1, dtype=np.int64)
        line = np.arange(len(word))
        rest = n - np.where(byte > 0, upto[line, byte - 1], 0)
        return word * 64 + byte * 8 + PLACES[own[line, byte], rest]

    def _one(self, n: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, n, side="right") - 1
        return self._in_word(word, n - self.before[word], False)

    def _zero(self, n: np.ndarray) -> np.ndarray:
        zeros = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        word = np.searchsorted(zeros, n, side="right") - 1
        return self._in_word(word, n - zeros[word], True)

    def _lows(self, at: np.ndarray) -> np.ndarray:
        place = at * self.bits
        eight = self.low[(place >> 3)[:, None] + np.arange(8)]
        return np.ascontiguousarray(eight).view("<u8").ravel() >> (place & 7).astype(np.uint64) & np.uint64((1 << self.bits) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self._one(at) - at).astype(np.uint64) << np.uint64(self.bits) | self._lows(at)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Index of the first element that is not below each value; ``n`` if there is none."""
        values = values.astype(np.uint64)
        high, low = values >> np.uint64(self.bits), values & np.uint64((1 << self.bits) - 1)
        zeros = len(self.before) * 64 - 64 - int(self.before[-1])
        beyond = high >= np.uint64(zeros)
        own = np.where(beyond, 0, high).astype(np.int64)
        first = np.where(own > 0, self._zero(np.maximum(own - 1, 0)) - own + 1, 0)
        last = self._zero(own) - own
        while (open_ := np.flatnonzero(first < last)).size:  # halves what has this high part
            middle = (first[open_] + last[open_]) >> 1
            less = self._lows(middle) < low[open_]
            first[open_], last[open_] = np.where(less, middle + 1, first[open_]), np.where(less, last[open_], middle)
        return np.where(beyond, self.n, first)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value; -1 where it is not in the sequence."""
        at = self.successor(values)
        inside = at < self.n
        out = np.full(len(at), -1, np.int64)
        out[inside] = np.where(self[at[inside]] == values[inside].astype(np.uint64), at[inside], -1)
        return out


def mapped(arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays, read from a file that is mapped into memory and goes with the last of them."""
    handle, path = tempfile.mkstemp(suffix=".levels")
    try:
        places, at = {}, 0
        with os.fdopen(handle, "wb") as f:
            for name, a in arrays.items():
                places[name] = (at, a.dtype, a.nbytes)
                f.write(np.ascontiguousarray(a).tobytes())
                at += a.nbytes
                f.write(bytes(-at % 8))
                at += -at % 8
            f.write(bytes(8))
        whole = np.memmap(path, np.uint8, "r")
    finally:
        os.unlink(path)
    return {name: whole[at : at + size].view(kind) for name, (at, kind, size) in places.items()}
