"""64-bit hashes of words and of runs of words, computed in bulk."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task remembers.
REMEMBERED = 100_000


class WordHashes(dict):
    """Word -> its 64-bit hash; forgotten when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit number's bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on: a polynomial of their hashes, spread."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + n]
    return mix(out)
