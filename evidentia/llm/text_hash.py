"""Words, word hashes and shingle hashes of texts, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Word hashes that a task keeps; the table is emptied when full.
KNOWN_WORDS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """word -> 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def hashes(self, text: bytes | None) -> np.ndarray:
        """Hashes of the words of ``text``: A-Z lower-cased, split at ASCII white space. Null has none."""
        words = (text or b"").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words, in order; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = (out * STEP) ^ words[j : j + n]
        out = out * MIX2
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; a shorter, not empty sequence is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(grams(words, min(k, len(words))))
