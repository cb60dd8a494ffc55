"""Elias-Fano coding of non-decreasing numbers, with select and rank.

Of n numbers up to u the lowest l = floor(log2(u / n)) bits stand packed one after another; the rest of
number i is i + 1 set bits into a bit vector whose gaps count up, so that the bit's position less i is
the rest. That takes at most n * (2 + log2(u / n)) bits, and nothing is kept in tables of whole numbers:
the position of every SAMPLE-th set bit, as 32 bits, is all that select needs to start from.
"""

from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64
#: Set bits from one sampled position to the next.
SAMPLE = 512
_HEAD = struct.Struct("<QQBxxxI")


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode(values: np.ndarray) -> bytes:
    """The coded form of non-decreasing unsigned 64-bit numbers."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = []
    for first in range(0, n, 1 << 16):  # blocks of whole bytes, as 2**16 is a multiple of 8
        part = values[first : first + (1 << 16), None] >> np.arange(low_bits, dtype=U64)[None, :]
        low.append(np.packbits((part & U64(1)).astype(np.uint8), bitorder="little").tobytes())
    at = (values >> U64(low_bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    upper[at] = 1
    samples = at[::SAMPLE].astype("<u4")
    return b"".join([_HEAD.pack(n, len(upper), low_bits, len(samples)), _padded(samples.tobytes()), _padded(b"".join(low)), _padded(np.packbits(upper, bitorder="little").tobytes())])


class EliasFano:
    """Reads coded numbers in place: nothing but what is asked for is decoded."""

    def __init__(self, data: bytes):
        self.n, upper, self.low_bits, samples = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += samples * 4 + -samples * 4 % 8
        self.low = data[at : (at := at + (low := (self.n * self.low_bits + 7) // 8))]
        at += -low % 8
        self.words = np.frombuffer(data, "<u8", (upper + 63) // 64, at)

    def _select(self, i: int) -> int:
        """Position of set bit i."""
        at = int(self.samples[i // SAMPLE])
        rest, word = i % SAMPLE, at >> 6
        bits = int(self.words[word]) >> (at & 63) << (at & 63)
        while rest >= (ones := bits.bit_count()):
            rest -= ones
            word += 1
            bits = int(self.words[word])
        for _ in range(rest):
            bits &= bits - 1
        return (word << 6) + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return (self._select(i) - i << self.low_bits) | (low & ((1 << self.low_bits) - 1))

    def __len__(self) -> int:
        return self.n

    def slice(self, first: int, end: int) -> np.ndarray:
        """Numbers first..end - 1."""
        if first >= end:
            return np.zeros(0, U64)
        begin, stop = self._select(first), self._select(end - 1)
        bits = np.unpackbits(self.words[begin >> 6 : (stop >> 6) + 1].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)
        ones = ones[(ones >= (begin & 63)) & (ones <= stop - (begin & ~63))]
        high = ones + (begin & ~63) - np.arange(first, end)
        if not self.low_bits:
            return high.astype(U64)
        at = first * self.low_bits
        stored = np.frombuffer(self.low[at >> 3 : (end * self.low_bits + 7) >> 3], np.uint8)
        bits = np.unpackbits(stored, bitorder="little")[at & 7 :][: (end - first) * self.low_bits].reshape(-1, self.low_bits)
        low = (bits.astype(U64) << np.arange(self.low_bits, dtype=U64)).sum(1, dtype=U64)
        return (high.astype(U64) << U64(self.low_bits)) | low

    def rank(self, value: int) -> int:
        """How many numbers are at most `value`."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self[middle] <= value:
                low = middle + 1
            else:
                high = middle
        return low
