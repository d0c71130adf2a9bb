"""Whole-array word hashing of UTF-8 texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(7).randint(0, 1 << 63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, _UNBASE))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs without ASCII white space."""
    blank = np.ones(b.size + 2, dtype=bool)
    blank[1:-1] = SPACE[b]
    edge = blank[1:] != blank[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    up, down = _powers(1 << max(10, int(b.size).bit_length()))
    total = np.zeros(b.size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * up[: b.size], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
