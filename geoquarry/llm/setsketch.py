"""SetSketch registers of shingle sets: exponentially spaced, truncated minima.

Register i of a set is ``floor(1 - log_b(min of the exponential variates h_i(x)))``, cut to [0, Q + 1]. The
registers of a union are the element-wise maxima, equal registers are likelier the larger the Jaccard
similarity, and the counts of larger, smaller and equal registers give a joint maximum-likelihood estimate.
"""

from __future__ import annotations

import numpy as np

from geoquarry.llm.shingles import mix, randoms

BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
BASE, RATE, Q = 1.02, 20.0, 4094

_A = ((randoms(101, REGISTERS) >> np.uint64(32)) | np.uint64(1)).astype(np.uint32)[:, None]
_B = (randoms(211, REGISTERS) >> np.uint64(32)).astype(np.uint32)[:, None]
_BAND = randoms(307, BANDS)
_ROW = randoms(401, ROWS) | np.uint64(1)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 registers of a non-empty set of 64-bit hashes; blocks bound the memory for very long texts."""
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, dtype=np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    for i in range(0, len(hashes), 1024):
        np.minimum(low, (high[:, i : i + 1024] * _A + _B).min(axis=1), out=low)
    u = (low.astype(np.float64) + 0.5) / 2.0**32
    variate = -np.log1p(-u) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """int64 keys, one for each band; ``regs`` is (n, REGISTERS), the result (n, BANDS)."""
    r = mix(regs.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * _ROW
    return mix(r.sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: int = 101) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarity of pairs of register rows with known set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u) * (1 - 1e-9)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    like = sum(n[:, None] * np.log(np.maximum(x, 1e-300)) for n, x in ((more, up), (less, down), (same, 1 - up - down)))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]
