"""Word shingles as sets of 64-bit hashes, MinHash values of such sets, and comparisons."""

from __future__ import annotations

import numpy as np
import xxhash

_K = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_CHUNK = 1024


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; A-Z lower-cased, words end at blanks and tab to carriage return.

    Fewer words than ``width`` make one shingle; no words (or null) make none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(len(h), width)):
        out = out * _K + h[k : k + n]
    return np.unique(mix64(out))


class MinHash:
    def __init__(self, perms: int, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 32, perms, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, perms, dtype=np.uint64).astype(np.uint32)[:, None]

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """The least value under each permutation of a set that isn't empty."""
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(h), _CHUNK):
            np.minimum(out, (h[k : k + _CHUNK] * self.a + self.b).min(axis=1), out=out)
        return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(x) or not len(y):
        return False
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)
