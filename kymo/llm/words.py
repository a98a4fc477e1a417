"""Words and word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Hashes that a worker remembers; beyond that it forgets all and starts anew.
WORDS = 250_000
SHINGLE = 5
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


class WordHashes(dict):
    """Word -> 8 hash bytes."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = code = xxhash.xxh3_64_digest(word)
        return code

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text, with A-Z in lower case."""
        if not text:
            return np.zeros(0, np.uint64)
        if len(self) > WORDS:
            self.clear()
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.frombuffer(b"".join([self[w] for w in words]), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``k`` words; of fewer words the whole run as one; none of none."""
    n = min(k, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        total = mixed(total + words[j : len(words) - n + 1 + j] * _ODD[j % len(_ODD)])
    return total


def shingle_set(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    return np.unique(shingles(words, k))
