"""Elias-Fano codes of non-decreasing integers, with a select structure.

n values up to u take about 2 + log2(u / n) bits each: the low bits are packed
side by side, the high bits are unary in a bit vector. `select` samples the
place of every STRIDE-th one of that vector in 32 bits, so one value is found
from a sample and a scan of a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

STRIDE = 64
_HEAD = struct.Struct("<IBII")  # values, low bits, bytes of the high part, samples


def encode(values: np.ndarray) -> bytes:
    """The code of non-decreasing values from 0 to 2**31."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    v = values.astype(np.uint64)
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    high_bytes = np.packbits(high, bitorder="little")
    lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    samples = ones[::STRIDE].astype("<u4")
    return _HEAD.pack(n, low, len(high_bytes), len(samples)) + samples.tobytes() + high_bytes.tobytes() + np.packbits(lows.reshape(-1), bitorder="little").tobytes()


class Reader:
    """Random and full access to a code, without unpacking it first."""

    def __init__(self, code: bytes):
        self.n, self.low, high, samples = _HEAD.unpack_from(code)
        at = _HEAD.size
        self.samples = np.frombuffer(code, "<u4", samples, at)
        self.high = np.frombuffer(code, np.uint8, high, at + 4 * samples)
        self.lows = np.frombuffer(code, np.uint8, -1, at + 4 * samples + high)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // STRIDE]), i % STRIDE
        byte, bits = at >> 3, int(self.high[at >> 3]) & (0xFF << (at & 7))
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        value = (place - i) << self.low
        for b in range(self.low):
            k = i * self.low + b
            value |= (int(self.lows[k >> 3]) >> (k & 7) & 1) << b
        return value

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low
        if self.low and self.n:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
        return out
