"""Shifted Hilbert orderings of projected vectors, vectorised over rows."""

from __future__ import annotations

import numpy as np

#: Projected dimensions and bits of each; their product must fit 63 bits.
PLANES, BITS = 4, 15


def hilbert_keys(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points ``(n, d)`` in ``[0, 2**bits)``.

    The bit-transposition algorithm of J. Skilling (2004).
    """
    x = [c.astype(np.int64) for c in coords.T]
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = x[0] ^ np.where(high, p, swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


class Orderings:
    """``count`` orderings, each by its own random orthonormal projection and shift."""

    def __init__(self, width: int, count: int, radius: float, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.planes = min(width, PLANES)
        self.radius = radius or 1.0
        self.maps, self.shifts = [], []
        for k in range(count):
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0][:, : self.planes]
            self.maps.append(np.eye(width)[:, : self.planes] if k == 0 else turn)
            self.shifts.append(rng.random(self.planes))

    def keys(self, k: int, vectors: np.ndarray) -> np.ndarray:
        """Keys of ordering ``k``; every projected value lies within the radius."""
        spread = vectors @ self.maps[k] / self.radius  # -1 .. 1
        unit = (spread + 1.0 + self.shifts[k]) / 3.0
        grid = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(grid)
