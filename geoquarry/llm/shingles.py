"""Word shingles of whole texts as sorted 64-bit hashes, computed with numpy inside Spark tasks."""

from __future__ import annotations

import numpy as np

WORDS = 5

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = randoms(11, 256)
_COEF = randoms(23, 64) | np.uint64(1)
_P = 0x2545F4914F6CDD1D
_P_INV = pow(_P, -1, 1 << 64)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown by doubling."""
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * np.uint64(pow(_P, k, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * np.uint64(pow(_P_INV, k, 1 << 64))])
    return _pow, _inv


def word_hashes(text: str | None) -> np.ndarray:
    """One hash for each word (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case); empty for null or blank texts."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; with fewer words the whole sequence is the one shingle."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * _COEF[i]
    return np.unique(mix(total))
