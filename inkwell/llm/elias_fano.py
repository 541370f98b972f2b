"""Elias-Fano coding of ascending integers: low bits packed, high bits in unary, and a stored directory of samples for select.

Values are read a block at a time from the sample before them on; neither reading nor opening makes a table of all values.

Cases: no values give an empty code; equal values are allowed; a place outside 0..n-1 raises IndexError.
"""

from __future__ import annotations

import struct

import numpy as np

#: The place in the high bits of every so many values is stored.
SAMPLE = 64
_HEAD = "<QQBQQ"


class EliasFano:
    """n values of at most top, ascending. About 2 + log2(top / n) bits each, and half a bit for its sample."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        mask = np.uint64((1 << bits) - 1)
        low = np.packbits((((v & mask)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits and n else np.zeros(0, np.uint8)
        high = np.zeros((top >> bits) + n + 1 if n else 0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high[ones] = 1
        return cls(n, top, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))  # a file's high bits are few

    def to_bytes(self) -> bytes:
        return struct.pack(_HEAD, self.n, self.top, self.low_bits, len(self.low), len(self.samples)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, bits, size, known = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        samples = np.frombuffer(data, "<u4", known, at)
        at += 4 * known
        return cls(n, top, bits, np.frombuffer(data, np.uint8, size, at), np.frombuffer(data, np.uint8, -1, at + size), samples)

    def block(self, start: int, stop: int) -> np.ndarray:
        """Values start..stop-1, read from the sample before the first to the sample behind the last."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint64)
        first, behind = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin, end = int(self.samples[first]), int(self.samples[behind]) if behind < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin >> 3 : (end + 7) >> 3], bitorder="little")[begin & 7 :]
        skip = start - first * SAMPLE
        ones = np.flatnonzero(bits)[skip : skip + stop - start] + begin
        value = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return value
        at, until = start * self.low_bits, stop * self.low_bits
        low = np.unpackbits(self.low[at >> 3 : (until + 7) >> 3], bitorder="little")[at & 7 :][: until - at]
        return value | (low.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """Value i."""
        if i < 0:
            raise IndexError(i)
        return int(self.block(i, i + 1)[0])
