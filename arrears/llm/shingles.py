"""Sets of word shingles, as hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: A-Z to a-z; bytes.split() then cuts at the bytes 20 and 09 to 0D
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MOST_WORDS = 150_000
_MULTIPLY, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Hashes of the first words met, which hold the frequent ones."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MOST_WORDS and len(word) <= 64:
            self[word] = value
        return value


#: serves all tasks of a Python worker
KNOWN = WordHashes()


def shingle_set(text: bytes, known: WordHashes = KNOWN, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted uint64 hashes; with fewer
    words than a shingle has, the whole sequence is one; without words none."""
    cut = text.translate(_LOWER).split()
    if not cut:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))
    k = min(words, len(cut))
    n = len(cut) - k + 1
    out = own[:n].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MULTIPLY
        out += own[j:j + n]
    out ^= out >> np.uint64(32)
    out *= _LAST
    return np.unique(out ^ np.uint64(k))
