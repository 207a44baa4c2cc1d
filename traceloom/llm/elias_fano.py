"""Elias-Fano code of a non-decreasing sequence: low bits packed, high parts in unary, select by samples."""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<IBQQI")


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        places = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1 if n else 0), np.uint8)
        bits[ones] = 1
        # The bit at which every SAMPLE-th value stands: select starts there instead of at the front.
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        start, stop = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select_many(np.array([i]))[0])

    def select_many(self, which: np.ndarray) -> np.ndarray:
        """The values at the places `which`: from the sample before each, over 64 bits at a time, as far as it takes."""
        which = np.asarray(which, np.int64)
        bit = self.samples[which // SAMPLE].astype(np.int64)
        words = np.frombuffer(self.high.tobytes() + bytes(-len(self.high) % 8), "<u8")
        at = bit // 64
        word = words[at] >> (bit % 64).astype(np.uint64) << (bit % 64).astype(np.uint64)  # nothing before the sample
        left = which % SAMPLE
        ahead = np.arange(len(which))
        while len(ahead):
            ones = np.bitwise_count(word[ahead]).astype(np.int64)
            ahead, ones = ahead[left[ahead] >= ones], ones[left[ahead] >= ones]
            left[ahead] -= ones
            at[ahead] += 1
            word[ahead] = words[at[ahead]]
        for _ in range(int(left.max(initial=0))):  # the lowest ones go until the wanted one is the lowest
            more = left > 0
            word[more] &= word[more] - np.uint64(1)
            left[more] -= 1
        lowest = np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        return ((at * 64 + lowest - which) << self.low_bits) | self._low_many(which)

    def _low_many(self, which: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(which), np.int64)
        places = which[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = self.low[places // 8] >> (places % 8).astype(np.uint8) & np.uint8(1)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The code that starts at `at`, and where it ends."""
        n, low_bits, lows, highs, samples = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low, high = np.frombuffer(data, np.uint8, lows, at), np.frombuffer(data, np.uint8, highs, at + lows)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", samples, at + lows + highs)), at + lows + highs + 4 * samples
