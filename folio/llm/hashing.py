"""Polynomial prefix hashes over bytes, in numpy, modulo 2^64."""

from __future__ import annotations

import numpy as np

#: an odd 64-bit multiplier, so that it has an inverse modulo 2^64
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..BASE^n and the inverses of these, kept between calls."""
    if len(_tables[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, b in enumerate((BASE, _INVERSE)):
            table = np.full(size, b, np.uint64)
            table[0] = 1
            _tables[k] = np.cumprod(table, dtype=np.uint64)
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads the low entropy of polynomial hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = hash of data[i:j] times BASE^i."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:], dtype=np.uint64)
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], by place-independent value."""
    _, down = powers(len(p))
    return (p[end] - p[start]) * down[start]
