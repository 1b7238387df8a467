"""Elias-Fano coding of a non-decreasing sequence.

Each of n values up to u keeps its low ``floor(log2(u / n))`` bits in a packed
array; the high parts are written in unary into a bit vector of about 2n bits.
The position of every ``STEP``-th one is sampled, so ``select(i)`` jumps to a
sample and scans at most a few words: about 2 + log2(u / n) bits a value and
no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QqBQQ")     # n, smallest value, low bits, bytes of low part, bytes of high part
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray,
                 samples: np.ndarray):
        self.n, self.least, self.low_bits = n, least, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        if (v[1:] < v[:-1]).any():
            raise ValueError("values must not decrease")
        least, u = int(v[0]), int(v[-1]) - int(v[0])
        v = v.view(np.uint64) - v[:1].view(np.uint64)        # modulo 2^64: right for any span of 64-bit values
        bits = max(0, (u // n).bit_length() - 1)
        low = np.packbits(((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1, np.uint8)
        vector[ones] = 1
        return cls(n, least, bits, low, np.packbits(vector, bitorder="little"), ones[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (_HEAD.pack(self.n, self.least, self.low_bits, len(self.low), len(self.high))
                + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at byte ``at`` and the byte after it."""
        n, least, bits, n_low, n_high = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        at += n_low + n_high
        samples = np.frombuffer(data, "<u4", -(-n // STEP), at)
        return cls(n, least, bits, low, high, samples), at + 4 * len(samples)

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        b = self.low_bits
        start, end = first * b, (first + count) * b
        bits = np.unpackbits(self.low[start // 8:-(-end // 8)], bitorder="little")[start % 8:start % 8 + count * b]
        return bits.reshape(count, b).astype(np.int64) @ (np.int64(1) << np.arange(b, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value (from 0)."""
        return int(self.slice(i, 1)[0])

    def slice(self, first: int, count: int) -> np.ndarray:
        """``count`` values from the ``first``: one jump, then a scan."""
        if first < 0 or count < 0 or first + count > self.n:
            raise IndexError(f"{first} + {count} of {self.n}")
        if not count:
            return np.zeros(0, np.int64)
        byte = int(self.samples[first // STEP]) // 8
        bits_before = int(np.unpackbits(self.high[byte:byte + 1], bitorder="little")
                          [:int(self.samples[first // STEP]) % 8].sum())
        skip = first % STEP + bits_before            # ones from that byte on, before the first wanted
        need, end = skip + count, byte
        while need > 0:                              # whole blocks of bytes until enough ones are in
            block = self.high[end:end + 4096]
            need -= int(_ONES[block].sum())
            end += len(block)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:end], bitorder="little"))[skip:skip + count]
        highs = ones + byte * 8 - np.arange(first, first + count)
        high = highs.astype(np.uint64) << np.uint64(self.low_bits)
        return (high + self._lows(first, count).view(np.uint64) + np.array([self.least]).view(np.uint64)).view(np.int64)
