"""Texts of an Arrow batch as numpy arrays: where words start and end, and their hashes.

A word is a run of bytes other than space and 0x09 to 0x0D. UTF-8 never uses these bytes inside
a character, so words of the encoded text are the words of the text. All work is done on whole
arrays over some megabytes of text, never word by word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
POWER_BLOCK = 1 << 14
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
WINDOW_FACTORS = _RNG.integers(1, 1 << 63, (2, 64), dtype=np.int64).astype(_U) * _U(2) + _U(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64; a bijection."""
    h = h ^ (h >> _U(30))
    h *= _MIX[0]
    h ^= h >> _U(27)
    h *= _MIX[1]
    h ^= h >> _U(31)
    return h


@lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to POWER_BLOCK of a hash's base, and of its inverse; small, whatever the text."""
    base = _BASES[which]
    steps = [np.full(POWER_BLOCK + 1, _U(b)) for b in (base, pow(base, -1, 1 << 64))]
    for s in steps:
        s[0] = 1
    return tuple(np.cumprod(s) for s in steps)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task, which hands its free memory back to the system at its end: Python workers
    wait for later tasks, and beside them others run."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another system's allocator
                pass

    return tidied


class Texts:
    """Consecutive texts of one column: bytes, bounds of the texts, words."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, fold: bool = False):
        self.first, self.count = first, len(bounds) - 1
        self.data = _FOLD[data] if fold else data
        self.bounds = bounds
        self._sums: dict[int, np.ndarray] = {}

    def find_words(self) -> "Texts":
        inside = ~SPACE[self.data]
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.bounds
        before[edges[:-1][edges[:-1] < n]] = False
        after[edges[1:][edges[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        # words[i] to words[i + 1] are the words of text i
        self.words = np.searchsorted(self.starts, self.bounds)
        self.inside = inside
        return self

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), np.diff(self.words))

    def _running(self, which: int) -> np.ndarray:
        """Running sums of byte values times powers that start anew with every POWER_BLOCK bytes."""
        if which not in self._sums:
            power, n = _powers(which)[0], len(self.data)
            values, whole = _BYTE_VALUES[which][self.data], n // POWER_BLOCK * POWER_BLOCK
            values[:whole].reshape(-1, POWER_BLOCK)[:] *= power[:POWER_BLOCK]
            values[whole:] *= power[: n - whole]
            sums = self._sums[which] = np.zeros(n + 1, _U)
            np.cumsum(values, out=sums[1:])
        return self._sums[which]

    def forget(self) -> None:
        """Let the running sums go, where no more hashes are wanted."""
        self._sums.clear()

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """64-bit polynomial hashes of byte ranges; the few that cross a block are put together."""
        sums, (power, inverse) = self._running(which), _powers(which)
        out = (sums[ends] - sums[starts]) * inverse[starts % POWER_BLOCK]
        across = np.flatnonzero((ends - 1) // POWER_BLOCK > starts // POWER_BLOCK)
        if len(across):
            at, stop = starts[across], ends[across]
            edge = (at // POWER_BLOCK + 1) * POWER_BLOCK
            total, scale = (sums[edge] - sums[at]) * inverse[at % POWER_BLOCK], power[edge - at]
            while (edge < stop).any():
                upto = np.minimum(edge + POWER_BLOCK, stop)
                total += (sums[upto] - sums[edge]) * scale
                scale, edge = scale * power[POWER_BLOCK], upto
            out[across] = total
        return mix(out)

    def word_hashes(self, which: int = 0) -> np.ndarray:
        return self.hashes(self.starts, self.ends, which)

    def per_text(self, per_byte: np.ndarray) -> np.ndarray:
        """Sums of a per-byte number over each text."""
        sums = np.zeros(len(per_byte) + 1, np.int64)
        np.cumsum(per_byte, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]


def windows(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries; runs over a text's end included."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j in range(size):
        total += h[j : j + n] * WINDOW_FACTORS[which][j]
    return mix(total)


def runs_inside(words: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the ``n`` windows stay inside one text."""
    good = np.ones(n, bool)
    edges = words[1:-1]
    for j in range(1, size):
        at = edges - j
        good[at[(at >= 0) & (at < n)]] = False
    return good


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a binary or string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, fold: bool = False, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts in order, some megabytes at a time; one longer text stands alone."""
    data, at = column_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Texts(data[at[i] : at[j]], at[i : j + 1] - at[i], i, fold)
        i = j
