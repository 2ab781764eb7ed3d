"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int = 5) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; of the whole sequence if it is shorter."""
    from xxhash import xxh3_64_intdigest

    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : n - k + 1 + j]
    return mixed(out)
