"""Elias-Fano coding of non-decreasing integers, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

#: Every so many ones of the upper bits, their position is kept (32 bits); select scans from there.
SAMPLE = 256
_HEAD = struct.Struct("<QQBQ")


class EliasFano:
    """n values of 0..u: the low l = floor(log2(u / n)) bits of each lie packed; the high bits are unary gaps in a
    bit vector of about 2n bits. Value i is the i-th one's position less i, with the low bits behind it. Takes
    about 2 + log2(u / n) bits a value, plus 1/8 bit for the select samples."""

    def __init__(self, n: int, last: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.last, self.low_bits, self.low, self.upper, self.samples = n, last, low_bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        if len(v) and (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        n, last = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        high = (v >> np.uint64(low_bits)).astype(np.int64)
        ones = high + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        if low_bits:
            planes = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(planes.ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        return cls(n, last, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        body = self.low.tobytes() + self.upper.tobytes() + self.samples.tobytes()
        return _HEAD.pack(self.n, self.last, self.low_bits, len(self.upper)) + body

    @classmethod
    def from_buffer(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the start of ``data``, and how many bytes it takes."""
        n, last, low_bits, n_upper = _HEAD.unpack_from(data)
        at = _HEAD.size
        n_low, n_samples = -(-n * low_bits // 8), -(-n // SAMPLE)
        low = np.frombuffer(data, np.uint8, n_low, at)
        upper = np.frombuffer(data, np.uint8, n_upper, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_upper)
        return cls(n, last, low_bits, low, upper, samples), at + n_low + n_upper + 4 * n_samples

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """The position of the i-th one."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        window = np.unpackbits(self.upper[byte : byte + 1], bitorder="little")
        window[: at % 8] = 0
        base = byte * 8
        while True:
            ones = np.flatnonzero(window)
            if left < len(ones):
                return base + int(ones[left])
            left -= len(ones)
            base += len(window)
            window = np.unpackbits(self.upper[base // 8 : base // 8 + 64], bitorder="little")

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        high, low = self._select(i) - i, 0
        if self.low_bits:
            a = i * self.low_bits
            b = a + self.low_bits
            bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + self.low_bits]
            low = int((bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum())
        return high << self.low_bits | low

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1: select finds the first one's place, and no more of either part is read than they take."""
        b = min(b, self.n)
        if a >= b:
            return np.zeros(0, np.int64)
        first, last = self._select(a), self._select(b - 1)
        byte = first // 8
        ones = np.flatnonzero(np.unpackbits(self.upper[byte : last // 8 + 1], bitorder="little")) + 8 * byte
        ones = ones[np.searchsorted(ones, first) :][: b - a]
        v = (ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            start = a * self.low_bits
            bits = np.unpackbits(self.low[start // 8 : -(-b * self.low_bits // 8)], bitorder="little")[start % 8 :][: (b - a) * self.low_bits]
            v |= (bits.reshape(b - a, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return v.astype(np.int64)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        return self.slice(0, self.n)
