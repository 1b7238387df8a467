"""Hashes of word windows over many documents at once."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
#: odd multipliers of two independent polynomial hashes modulo 2^64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        steps = np.empty((2, size), np.uint64)
        steps[:] = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
        steps[:, 0] = 1
        up, down = np.cumprod(steps, axis=1, dtype=np.uint64)
        _POWERS[base] = up, down
    up, down = _POWERS[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Windows:
    """Prefix hashes of a sequence of word hashes: any window in O(1)."""

    def __init__(self, hashes: np.ndarray, base: int):
        self.up, self.down = _powers(base, len(hashes) + 1)
        self.prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[:len(hashes)], out=self.prefix[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words [first, last), equal wherever they stand."""
        return mix((self.prefix[last] - self.prefix[first]) * self.down[first])


def sliding_argmin(values: np.ndarray, length: int) -> np.ndarray:
    """For each place the first place of the least of ``length`` values from
    it on, by the upper 32 bits of the values."""
    m = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while 2 * reach <= length:
        m = np.minimum(m[:len(m) - reach], m[reach:])
        reach *= 2
    if reach < length:
        step = length - reach
        m = np.minimum(m[:len(m) - step], m[step:])
    return (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
