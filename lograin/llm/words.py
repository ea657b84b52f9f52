"""Hashed words of texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash


class WordHashes(dict):
    """Word -> 64-bit hash, with a bounded memory of words seen.

    Words are runs of bytes other than the six ASCII white-space characters, A-Z lowered.
    """

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        words = (text or "").encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _constants(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b"shingle", seed=i) | 1 for i in range(n)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole text if it has fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    constants = _constants(size + 1)
    count = len(words) - size + 1
    total = np.repeat(constants[size : size + 1] * np.uint64(size), count)
    for i in range(size):
        total += words[i : i + count] * constants[i]
    return np.unique(mixed(total))
