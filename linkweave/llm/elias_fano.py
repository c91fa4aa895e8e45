"""Elias-Fano coding of non-decreasing integers, with select.

``n`` values below ``u`` take about ``n * (2 + log2(u / n))`` bits: the low bits of
each value are stored as they are, the high bits as one set bit a value in a bit
vector.  A sampled directory, which is stored with them, says where in that vector
every ``SAMPLE``-th set bit is; select goes on from there, so no table of 64-bit offsets
is made or kept.  Values are coded and decoded in pieces: memory beyond the
code itself is bounded.
"""

from __future__ import annotations

import struct

import numpy as np

#: One directory entry for so many values.
SAMPLE = 256
#: Values coded at once.
PIECE = 1 << 16
_HEAD = struct.Struct("<QQBxxxxxxxQ")  # values, universe, low bits, bytes of the high vector
#: Where the k-th set bit of a byte is.
_PLACES = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A coded sequence.  ``directory``: for every SAMPLE-th value the place of its bit in the high vector."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.directory = n, universe, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """``values``: non-decreasing, none negative."""
        v = np.asarray(values)
        n = len(v)
        if n == 0:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, "<u4"))
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        universe = int(v[-1]) + 1
        low_bits = max(0, (universe // n).bit_length() - 1)
        if (int(v[-1]) >> low_bits) + n > 1 << 32:
            raise ValueError("too many values for one sequence")
        low = np.zeros((n * low_bits + 7) // 8, np.uint8)
        high = np.zeros(((int(v[-1]) >> low_bits) + n + 7) // 8, np.uint8)
        directory = np.zeros(-(-n // SAMPLE), "<u4")
        for first in range(0, n, PIECE):  # PIECE is a multiple of 8 and of SAMPLE
            part = v[first : first + PIECE].astype(np.uint64)
            at = (part >> np.uint64(low_bits)).astype(np.int64) + np.arange(first, first + len(part))
            np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
            directory[first // SAMPLE : -(-(first + len(part)) // SAMPLE)] = at[::SAMPLE]
            if low_bits:
                bits = (part[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits.ravel(), bitorder="little")
                low[first * low_bits // 8 : first * low_bits // 8 + len(packed)] = packed
        return cls(n, universe, low_bits, low, high, directory)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.universe, self.low_bits, len(self.high)) + self.directory.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data) -> EliasFano:
        n, universe, low_bits, n_high = _HEAD.unpack_from(data)
        entries = -(-n // SAMPLE)
        at = _HEAD.size + 4 * entries
        return cls(n, universe, low_bits, np.frombuffer(data, np.uint8, (n * low_bits + 7) // 8, at + n_high), np.frombuffer(data, np.uint8, n_high, at), np.frombuffer(data, "<u4", entries, _HEAD.size))

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int, j: int) -> np.ndarray | int:
        """Low bits of the values from i to j."""
        if not self.low_bits:
            return 0
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 : first % 8 + last - first]
        return bits.reshape(j - i, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def _bit(self, i: int) -> int:
        """Where the bit of the i-th value is in the high vector."""
        entry = i // SAMPLE
        at, seen = int(self.directory[entry]), entry * SAMPLE
        byte = at >> 3
        seen -= (int(self.high[byte]) & ((1 << (at & 7)) - 1)).bit_count()  # bits of its byte that are of values before
        while (here := int(self.high[byte]).bit_count()) + seen <= i:
            seen, byte = seen + here, byte + 1
        return 8 * byte + int(_PLACES[self.high[byte], i - seen])

    def select(self, i: int) -> int:
        """The i-th value, from 0."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = int(self._low(i, i + 1)[0]) if self.low_bits else 0
        return (self._bit(i) - i) << self.low_bits | low

    def values(self, i: int = 0, j: int | None = None) -> np.ndarray:
        """The values from i to j, found by two selects and decoded at once."""
        j = self.n if j is None else j
        if not 0 <= i <= j <= self.n:
            raise IndexError((i, j))
        if i == j:
            return np.zeros(0, np.int64)
        first, last = self._bit(i), self._bit(j - 1)
        bits = np.unpackbits(self.high[first >> 3 : (last >> 3) + 1], bitorder="little")
        at = np.flatnonzero(bits[first & 7 : last + 1 - (first >> 3 << 3)]) + first
        return ((at - np.arange(i, j)) << self.low_bits) | self._low(i, j)

    def above(self, value: int) -> int:
        """How many values are at most ``value``: a binary search by select."""
        left, right = 0, self.n
        while left < right:
            middle = (left + right) // 2
            left, right = (middle + 1, right) if self.select(middle) <= value else (left, middle)
        return left
