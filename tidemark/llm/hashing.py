"""Vectorised 64-bit hashing of bytes, the same in every process.

A byte string hashes to the sum of ``T[byte] * R**position`` modulo 2**64 with odd R, so hashes of any substring
come from prefix sums, shifted back by the inverse power; a finaliser spreads the bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums over bytes, one more than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def spans(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [begin, end)."""
    return final((sums[end] - sums[begin]) * powers(_INVERSE, len(sums))[begin] + (end - begin).astype(np.uint64))


def grams(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return final((sums[size:] - sums[:-size]) * powers(_INVERSE, len(sums))[:n] + U(size))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end (in the texts joined by a space) of every word, and the number of words of each text."""
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[data]
    step = np.diff(solid)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    edges = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, edges, side="left"), prepend=0)
    return spans(prefix(data), begin, end), begin, end, counts
