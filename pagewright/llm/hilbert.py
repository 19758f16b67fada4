"""Keys along a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each point; points: rows of whole numbers of `bits` bits, dimensions * bits at most 63.

    From the highest bit down, what a cell's place among its neighbours says turns the axes of all that lies within it: either
    an axis is mirrored below that bit, or it trades places with the first one. The turned bits, as a Gray code, are the key.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i in range(n):
            high = (x[i] >> level) & 1
            x[0] ^= np.where(high == 1, below, 0)
            swap = np.where(high == 0, (x[0] ^ x[i]) & below, 0)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key
