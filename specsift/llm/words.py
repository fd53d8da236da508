"""Vectorised word splitting and hashing of Arrow string columns (in-task helper).

Texts are handled as UTF-8 bytes in slices of a few MB, so a task's memory
does not grow with the batch.  A word is a maximal run of word bytes inside
one text; two classes are offered:

* ``SPACED``: everything but ASCII white space (x20, x09-x0D);
* ``ALNUM``: ASCII letters and digits and every non-ASCII character.

Hashes are 64-bit: a polynomial over the bytes from prefix sums (modulo
2**64, odd base, so that a prefix can be divided out), then a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

LINES = np.ones(256, dtype=bool)
LINES[0x0A] = False

_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown on demand, kept per worker."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * SLICE_BYTES:  # one very long text: do not keep the tables
            return out[0], out[1]
        _pow, _inv = out
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of a slice of texts; word i is ``data[starts[i]:ends[i]]``.

    ``first[d]:first[d + 1]`` are the words of text d of the slice.
    """

    rows: range
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        v = self.data.astype(np.uint64)
        v += _U(1)
        v *= power[:n]
        np.cumsum(v, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, dtype=np.uint8), off.astype(np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[range]:
    """Row ranges of at most ``limit`` bytes (a longer text is a range of its own)."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield range(at, to)
        at = to


def split_words(column: pa.Array, kind: np.ndarray, lower: bool = True) -> Iterator[Words]:
    """The words of each slice of a string column."""
    raw, offsets = string_buffers(column)
    for rows in slices(offsets):
        lo, hi = offsets[rows.start], offsets[rows.stop]
        data = raw[lo:hi]
        if lower:
            data = LOWER[data]
        bounds = offsets[rows.start : rows.stop + 1] - lo
        yield _split(rows, data, bounds, kind)


def _split(rows: range, data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> Words:
    inside = kind[data]
    n = len(data)
    begins = bounds[:-1][np.diff(bounds) > 0]
    is_start = inside.copy()
    is_end = inside.copy()
    if n:
        is_start[1:] &= ~inside[:-1]
        is_start[begins] = inside[begins]
        is_end[:-1] &= ~inside[1:]
        last = bounds[1:][np.diff(bounds) > 0] - 1
        is_end[last] = inside[last]
    starts = np.flatnonzero(is_start)
    ends = np.flatnonzero(is_end) + 1
    first = np.searchsorted(starts, bounds)
    return Words(rows, data, bounds, starts, ends, first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (length ``len(h) - k + 1``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= _U(0x9E3779B97F4A7C15)
        out += h[i : i + n]
    return mix(out)
