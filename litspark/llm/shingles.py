"""Word shingles of texts as 64-bit hashes, in numpy over the bytes of a batch."""

from __future__ import annotations

import numpy as np

GAP = np.zeros(256, bool)
GAP[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """BASE to the powers 0 to n - 1, modulo 2 ** 64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), BASE, np.uint64))
        _powers = np.concatenate([np.ones(1, np.uint64), _powers])
    return _powers[:n]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of UTF-8 bytes, A-Z taken as a-z."""
    solid = np.flatnonzero(~GAP[data])
    if not len(solid):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    size = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, size)
    value = (LOWER[data[solid]].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[place]
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64))


def shingle_set(text: str, width: int = 4) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; with fewer words the whole sequence is the only one."""
    words = word_hashes(np.frombuffer(text.encode(), np.uint8))
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    value = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        value = mixed(value * BASE + words[i : n - k + 1 + i])
    return np.unique(value)
