"""Hilbert keys of points in a few dimensions, for a whole batch at once."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer ``cells`` (rows of ``dims`` values below
    ``2**bits``; ``dims * bits`` at most 63), as int64."""
    x = cells.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of each level, from the coarsest
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(turned, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray encode
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    q = top
    while q > 1:
        flips ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flips
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | x[i] >> bit & 1
    return key
