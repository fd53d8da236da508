"""Elias-Fano coding of a non-decreasing sequence (in-task helper).

n values up to u take about ``n * (2 + log2(u / n))`` bits: the low
``floor(log2(u / n))`` bits of every value are packed one after another, the
rest is a bit vector that holds, for value i, a one at ``(value >> low) + i``.
``select`` finds the i-th one from a sample of every 256th position, stored in
32 bits, so no table of 64-bit offsets is kept.
"""

from __future__ import annotations

import struct

import numpy as np

#: One position in so many is stored for ``select``.
SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")  # values, first value, low bits, bytes of high bits, samples


def _bits(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Bits first..last of a byte array, as 0/1."""
    lo = first >> 3
    return np.unpackbits(data[lo : (last + 7) >> 3], bitorder="little")[first - 8 * lo : last - 8 * lo]


class EliasFano:
    """Encoded values; 64-bit unsigned arithmetic relative to the first one."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Values: int64 or uint64, non-decreasing."""
        n = len(values)
        if n == 0:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        x = values.astype(np.uint64) - values[:1].astype(np.uint64)  # modulo 2**64: right for any int64 range
        low_bits = max(0, (int(x[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((x[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        if ones[-1] >= 1 << 32:
            raise ValueError("too many values for 32-bit samples")
        vector = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        vector[ones] = 1
        return cls(n, int(values[0]), low_bits, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def slice(self, first: int, last: int) -> np.ndarray:
        """Values first..last-1 as int64."""
        if first >= last:
            return np.zeros(0, np.int64)
        block = first // SAMPLE
        begin = int(self.samples[block])
        until = -(-last // SAMPLE)
        end = int(self.samples[until]) if until < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(_bits(self.high, begin, end))[first - block * SAMPLE :][: last - first] + begin
        x = (ones - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            parts = _bits(self.low, first * self.low_bits, last * self.low_bits).reshape(-1, self.low_bits).astype(np.uint64)
            x |= parts @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return (x + np.uint64(self.base % (1 << 64))).astype(np.int64)

    def select(self, i: int) -> int:
        """Value i, reading the bits between two samples only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.base % (1 << 64), self.low_bits, len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """(the sequence that starts at byte ``at``, the byte after it)."""
        n, base, low_bits, n_high, n_samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        base = base - (1 << 64) if base >= 1 << 63 else base
        n_low = (n * low_bits + 7) // 8
        cut = lambda kind, count: np.frombuffer(data, kind, count, at)
        low = cut(np.uint8, n_low)
        at += n_low
        high = cut(np.uint8, n_high)
        at += n_high
        samples = cut("<u4", n_samples)
        return cls(n, base, low_bits, low, high, samples), at + 4 * n_samples
