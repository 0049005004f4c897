"""Keys of points along Hilbert curves."""

from __future__ import annotations

import numpy as np


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of whole numbers (0 to 2**bits - 1) on the curve through its grid.

    The coordinates are turned into the Gray-coded, transposed form of the place, one bit
    plane after another, and the bits are then interleaved. Rows times bits stay below 64.
    """
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    plane = np.uint64(1) << np.uint64(bits - 1)
    while plane > 1:
        low = plane - np.uint64(1)
        for i in range(n):
            high = (x[i] & plane) > 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= np.where(high & (i > 0), np.uint64(0), swap)
        plane >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    plane = np.uint64(1) << np.uint64(bits - 1)
    while plane > 1:
        flip ^= np.where((x[n - 1] & plane) > 0, plane - np.uint64(1), np.uint64(0))
        plane >>= np.uint64(1)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(bit)) & np.uint64(1))
    return key.astype(np.int64)
