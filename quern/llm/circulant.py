"""Circulant MinHash: all coordinates of a signature from two permutations.

The universe is the 2**64 hash values. One permutation scatters them; the other, shifted circularly by k places, orders
them for coordinate k: the coordinate of a set is the smallest place any of its scattered values gets. Both permutations
are bijections of 64-bit words (multiplications by odd numbers and xor-shifts), so no two values ever share a place, and a
shift is an addition that wraps around. Coordinates are joined into band keys at once and never kept themselves.
"""

from __future__ import annotations

import numpy as np

from quern.llm import textkernel as tk

_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_HALF = np.uint64(32)


def scatter(g: np.ndarray) -> np.ndarray:
    """The first permutation; it is applied once for all coordinates."""
    return tk.mix(g + np.uint64(0x9E3779B97F4A7C15))


def place(x: np.ndarray) -> np.ndarray:
    """The second permutation, which all coordinates share."""
    x = x * _A
    x ^= x >> _HALF
    x *= _B
    return x


def coordinate(scattered: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Coordinate k of each set; start: where the sets begin in `scattered`, none of them empty."""
    return np.minimum.reduceat(place(scattered + np.uint64(k)), start)


def band_keys(g: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The key of each band (sets x bands): `rows` coordinates each, no coordinate in two bands."""
    s = scatter(g)
    out = np.zeros((len(start), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(start), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = tk.mix(key * np.uint64(tk._R) + coordinate(s, start, k))
        out[:, b] = key
    return out
