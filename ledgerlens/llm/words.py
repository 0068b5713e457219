"""Vectorised hashes of words and of runs of words, over Arrow text buffers.

A word is a longest run of bytes other than space and \\t \\n \\v \\f \\r.  All
arithmetic is modulo 2**64 on numpy arrays: no Python loop runs over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_GRAM = 0xD1342543DE82EF95
_BLOCK = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x + U(salt)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=3)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse, at least ``size`` of each."""
    return _powers(base, 1 << max(10, int(size - 1).bit_length()))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary array; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """Words of a run of documents: ``hash`` by word, ``first`` (of each document, and the end), and byte bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        solid = ~space[data]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begins[edge] |= solid[edge]
        ends[edge - 1] |= solid[edge - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(data)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), U)
        at, n = 0, len(self.start)
        with np.errstate(over="ignore"):
            while at < n:
                begin = self.start[at]
                stop = max(at + 1, int(np.searchsorted(self.end, begin + _BLOCK, side="right")))
                end = self.end[stop - 1]
                up, down = powers(_BASE, int(end - begin) + 1)
                total = np.zeros(int(end - begin) + 1, U)
                np.cumsum((data[begin:end].astype(U) + U(1)) * up[: end - begin], out=total[1:])
                s, e = self.start[at:stop] - begin, self.end[at:stop] - begin
                out[at:stop] = mix((total[e] - total[s]) * down[s])
                at = stop
        return out


def grams(word: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of ``length`` consecutive entries of ``word``."""
    n = len(word) - length + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        up, down = powers(_GRAM, len(word) + 1)
        total = np.zeros(len(word) + 1, U)
        np.cumsum((mix(word, salt) if salt else word) * up[: len(word)], out=total[1:])
        return mix((total[length:] - total[:n]) * down[:n], length + salt)


def inside(first: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each word position: whether a run of ``length`` from there stays in its document."""
    ok = np.zeros(n + 1, np.int64)
    size = np.diff(first)
    full = size >= length
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[:-1][full] + size[full] - length + 1, -1)
    return np.cumsum(ok[:n]) > 0


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - have :])
    return out
