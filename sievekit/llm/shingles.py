"""Hashed word shingles of whole texts, computed over the bytes of an Arrow batch.

Words are the maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``
(UTF-8 continuation bytes never collide with those), ``A-Z`` count as
``a-z``. A word's hash is the sum of a random value per byte times a random
odd number per place in the word, modulo 2^64, mixed (two given words of any
length share it with a chance of about 2^-63; no run of letters that repeats
or mirrors itself is special); a shingle's hash combines its words' hashes the
same way. Everything is a handful of numpy passes over a slice of the batch, so
no Python object is made per word. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_VALUE = np.where(_SPACE, np.uint64(0), _BYTE)
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (two multiply-shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Multipliers:
    """A random odd number per place in a word, grown to the longest slice seen."""

    def __init__(self) -> None:
        self.at = np.ones(1, np.uint64)

    def to(self, n: int) -> np.ndarray:
        if len(self.at) < n:
            self.at = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
        return self.at


_MULTIPLIERS = _Multipliers()


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` slices of a string column of about ``limit`` bytes.

    A longer text is a slice of its own: no text is cut. Nulls are empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the slice and the word count bounds per row (length rows + 1)."""
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = off[:-1][off[:-1] < len(data)]
    start[firsts] = solid[firsts]
    at = np.flatnonzero(start)
    bounds = np.searchsorted(at, off)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    # Place of every byte in its word (what stands between words counts as 0).
    place = np.arange(at[0], len(data)) - np.repeat(at, np.diff(at, append=len(data)))
    value = _VALUE[data[at[0]:]] * _MULTIPLIERS.to(len(data))[place]
    return mix(np.add.reduceat(value, at - at[0])), bounds


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, sorted distinct shingle hashes)`` for every row of the column.

    A text of fewer than ``n`` words has its whole word sequence as its one
    shingle; a text without words has none.
    """
    for first, data, off in text_slices(texts):
        h, bounds = words_of(data, off)
        m = len(h) - n + 1
        if m > 0:
            acc = np.zeros(m, np.uint64)
            for k in range(n):
                acc += h[k:k + m] * _STEP[k]
            acc = mix(acc)
        for r in range(len(off) - 1):
            a, b = bounds[r], bounds[r + 1]
            if b - a >= n:
                yield first + r, np.unique(acc[a:b - n + 1])
            elif b > a:
                short = (h[a:b] * _STEP[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + r, mix(np.array([short], np.uint64))
            else:
                yield first + r, np.zeros(0, np.uint64)
