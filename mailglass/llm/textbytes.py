"""Words, shingles and byte n-grams of Arrow text columns, as numpy arrays.

Everything works on the UTF-8 bytes of many texts at once; a text is never cut.
Hashes are 64-bit: two different words share one with a chance of about
n * n / 2**65 for n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

#: Byte kinds: 0 separates words ([ \t\n\v\f\r]), 1 is part of a word.
WORD = np.ones(256, np.uint8)
WORD[[0x20, *range(0x09, 0x0E)]] = 0
#: The same with punctuation (2) apart from letters, digits and bytes of other scripts.
WORD_OR_MARK = WORD * 2
for _a, _z in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_OR_MARK[_a : _z + 1] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return (data[bounds[0] : bounds[-1]], bounds - bounds[0]) if len(bounds) else (data[:0], np.zeros(1, np.int64))


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of whole rows of about ``size`` bytes."""
    data, bounds = text_bytes(column)
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


def runs(data: np.ndarray, bounds: np.ndarray, kinds: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of one kind other than 0 inside a row."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = kinds[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[bounds[:-1][bounds[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(data))
    full = kind[starts] != 0
    return starts[full], ends[full]


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors)
    powers = _POWERS[0], _POWERS[1]
    if n > 4 * PIECE:  # do not keep what one long word asked for
        _POWERS[:] = [p[:PIECE].copy() for p in _POWERS]
    return powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit hash per run, from sums of bytes times powers; A-Z folded if ``lower``."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # slices of about PIECE bytes
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        a, z = starts[i], ends[j - 1]
        own = data[a:z]
        own = LOWER[own] if lower else own
        powers, inverse = _powers(z - a + 1)
        total = np.empty(len(own) + 1, np.uint64)
        total[0] = 0
        np.cumsum((own.astype(np.uint64) + np.uint64(1)) * powers[: len(own)], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * inverse[starts[i:j] - a]
        i = j
    return mix(out)


def row_counts(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many runs begin in each row."""
    return np.diff(np.searchsorted(starts, bounds))


def ngrams(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive values inside a row, and how many each row has."""
    keep = np.maximum(counts - n + 1, 0)
    if len(h) < n:
        return h[:0], keep
    grams = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        grams = grams * np.uint64(0x2545F4914F6CDD1D) + h[k : len(h) - n + 1 + k]
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(h))  # values from here to the row's end
    return mix(grams[left[: len(grams)] >= n]), keep


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``counts`` values; an empty stretch is 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out
