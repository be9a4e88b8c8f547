"""XXH3 (64 bits) of many words at once.

The values are those of ``xxhash.xxh3_64_intdigest``, which costs a call for
each word. Words of up to 16 bytes, nearly all, are hashed together as the
algorithm's description says for inputs that short; longer ones one by one.
"""

from __future__ import annotations

import numpy as np

from .shingles import KNOWN

MOST = 16
#: of XXH3's default secret, the words that inputs of 1 to 3, 4 to 8 and 9 to 16 bytes are mixed with
_FLIP3, _FLIP8, _FLIP_LO, _FLIP_HI = (np.uint64(x) for x in (
    0x396CFEB8 ^ 0xBE4BA423, 0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE,
    0x1F67B3B7A4A44072 ^ 0x78E5C0CC4EE679CB, 0x2172FFCC7DD05A82 ^ 0x8E2443F7744608B8))
_HALF = np.uint64(0xFFFFFFFF)


def _read(data: bytes, kind: str, at: np.ndarray) -> np.ndarray:
    """Numbers that begin at any bytes of ``data``."""
    size = np.dtype(kind).itemsize
    return np.ndarray((max(0, len(data) - size + 1),), kind, data, strides=(1,))[at].astype(np.uint64)


def _mixed(h: np.ndarray, *steps: tuple[int, int]) -> np.ndarray:
    """Shifted and multiplied in turn; 1 leaves out the product."""
    for shift, times in steps:
        h = h ^ h >> np.uint64(shift)
        if times != 1:
            h *= np.uint64(times)
    return h


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit product, one xor the other."""
    s = np.uint64(32)
    a0, a1, b0, b1 = a & _HALF, a >> s, b & _HALF, b >> s
    low, cross = a0 * b0, a1 * b0
    middle = (low >> s) + (cross & _HALF) + a0 * b1
    return ((cross >> s) + (middle >> s) + a1 * b1) ^ (middle << s | low & _HALF)


def word_hashes(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word ``data[begin:end]``, of one byte or more."""
    n = end - begin
    out = np.zeros(len(n), np.uint64)
    at = np.flatnonzero(n <= 3)
    i, j, k = begin[at], end[at], n[at]
    out[at] = _mixed((_read(data, "u1", i) << np.uint64(16) | _read(data, "u1", i + (k >> 1)) << np.uint64(24)
                      | _read(data, "u1", j - 1) | k.astype(np.uint64) << np.uint64(8)) ^ _FLIP3,
                     (33, 0xC2B2AE3D27D4EB4F), (29, 0x165667B19E3779F9), (32, 1))
    at = np.flatnonzero((n > 3) & (n <= 8))
    i, j, k = begin[at], end[at], n[at].astype(np.uint64)
    h = (_read(data, "<u4", j - 4) + (_read(data, "<u4", i) << np.uint64(32))) ^ _FLIP8
    h = (h ^ _turned(h, 49) ^ _turned(h, 24)) * np.uint64(0x9FB21C651E98DF25)
    out[at] = _mixed((h ^ (h >> np.uint64(35)) + k) * np.uint64(0x9FB21C651E98DF25), (28, 1))
    at = np.flatnonzero((n > 8) & (n <= MOST))
    i, j, k = begin[at], end[at], n[at].astype(np.uint64)
    lo, hi = _read(data, "<u8", i) ^ _FLIP_LO, _read(data, "<u8", j - 8) ^ _FLIP_HI
    out[at] = _mixed(k + lo.byteswap() + hi + _folded(lo, hi), (37, 0x165667919E3779F9), (32, 1))
    at = np.flatnonzero(n > MOST)
    out[at] = np.fromiter((KNOWN[data[i:j]] for i, j in zip(begin[at].tolist(), end[at].tolist(), strict=True)), np.uint64, len(at))
    return out
