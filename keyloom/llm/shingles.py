"""Shingle sets and MinHash signatures of texts."""

from __future__ import annotations

import numpy as np

WIDTH = 5
BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
"""A pair at similarity 0.75 misses all bands with probability (1 - 0.75^4)^40 = 2.5e-7."""


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes; fewer words than ``width`` make one shingle."""
    import xxhash
    words = text.lower().split()  # bytes: A-Z only, and the white space of the word rule only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    step = np.uint64(0x9E3779B97F4A7C15)
    out = np.full(len(h) - size + 1, np.uint64(size))
    for i in range(size):
        out = out * step + h[i:len(h) - size + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


MORE = 864
"""Further hashes, of 8 bits, for nodes that many others resemble."""


def permutations(n: int = HASHES, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1))[:, None], \
        rng.integers(0, 1 << 32, n, np.uint32)[:, None]


def signature(shingles: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The low 16 bits of the least value of every permutation over the set."""
    a, b = perms
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        np.minimum(out, (x[None, i:i + 1024] * a + b).min(axis=1), out=out)
    return (out ^ (out >> np.uint32(16))).astype("<u2")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row: equal exactly if the band's four values are."""
    packed = np.ascontiguousarray(signatures.astype("<u2")).view("<u8")
    band = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((packed ^ band) * np.uint64(0xFF51AFD7ED558CCD)).astype(np.int64)


def least_matches(similarity: float, miss: float, start: int = 32, step: int = 32, end: int = HASHES) -> list[tuple[int, int]]:
    """For each prefix of ``start``, ``start + step``, ... hashes the fewest matches that keep a pair.

    With a uniform prior, ``k`` matches in ``m`` leave the similarity a Beta(k + 1, m - k + 1) posterior, so
    P(similarity >= s | k of m) = P(Binomial(m + 1, s) <= k). Below ``miss`` the pair is dropped.
    """
    from math import comb
    out = []
    for m in range(start, end + 1, step):
        tail, k = 0.0, -1
        while tail < miss:
            k += 1
            tail += comb(m + 1, k) * similarity ** k * (1 - similarity) ** (m + 1 - k)
        out.append((m, k))
    return out
