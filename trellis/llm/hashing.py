"""Vectorised string hashes."""

from __future__ import annotations

import numpy as np


class Hasher:
    """Polynomial prefix hashes modulo 2**64 over random byte values: the hash of any
    substring in constant time. Two bases give independent names."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        n = len(raw)
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            self.up, self.down = (_powers(b, size) for b in (self.base, self.inverse))
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[raw] * self.up[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base & ((1 << 64) - 1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
