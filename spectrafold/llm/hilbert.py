"""Keys along a Hilbert curve of any dimension, for whole arrays of points."""

from __future__ import annotations

import numpy as np


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the curve of integer points (rows; 0 <= coordinate < 2**bits); dims * bits <= 63.

    The Gray-code form: undo the excess rotations from the highest bit down, then
    interleave the transposed coordinates.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        high, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & high) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key
