"""Hashes of the words of a text, and of runs of words, by numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Odd constants of the multiplications.
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ x >> np.uint64(30)
    x = x * _B
    x ^= x >> np.uint64(27)
    x *= _C
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _A | np.uint64(2)), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 1 to n of an odd number, modulo 2**64."""
    size = 1024
    while size < n:
        size *= 2
    return _powers(size)[:n]


@lru_cache(maxsize=1)
def _places(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _A) | np.uint64(1)


def places(n: int) -> np.ndarray:
    """An odd number for each of n places, without a rule between them that a word could follow."""
    size = 1024
    while size < n:
        size *= 2
    return _places(size)[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 text; equal words have equal hashes."""
    a = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[a], [False]))
    turn = (inside[1:] != inside[:-1]).nonzero()[0]
    start, end = turn[::2], turn[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    size = end - start
    dense = a[inside[1:-1]]
    first = np.cumsum(size) - size
    place = np.arange(len(dense)) - np.repeat(first, size)
    h = np.add.reduceat(mixed(_BYTES[dense] * places(int(size.max()))[place]), first)
    return mixed(h + size.astype(np.uint64)), start, end


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k consecutive words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, done, out = len(h) - k + 1, 0, np.zeros(len(h) - k + 1, np.uint64)
    part, size, p = h, 1, powers(max(2, k))
    while k > done:  # binary parts of k, from the lowest
        if (k - done) & size:
            out += part[done : done + n] * (p[done - 1] if done else np.uint64(1))
            done += size
        if done < k:
            part = part[:-size] + part[size:] * p[size - 1]
            size *= 2
    return mixed(out + np.uint64(k))
