"""Suffix arrays in numpy over many short pieces of bytes."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and packed first 8 bytes of each suffix.

    Larsson-Sadakane refinement: suffixes are ranked by their first 8 bytes, then groups of equal rank are sorted again
    by the rank of the suffix h further, h doubling. Suffixes that are equal to their ends are put in the order of position
    last, which Kasai's rule needs. end: of each position the end of its piece, at which its suffix ends.
    """
    n = len(data)
    at = np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    packed = np.zeros(n, np.uint64)
    for i in range(8):
        packed = (packed << np.uint64(8)) | np.where(at + i < end, padded[i : n + i], 0).astype(np.uint64)
    depth = int((end - at).max(initial=0))
    sa = np.argsort(packed)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = packed[sa[1:]] != packed[sa[:-1]]
    h = 8
    while True:
        heads = np.flatnonzero(new)
        size = np.diff(heads, append=n)
        rank = np.empty(n, np.int64)
        rank[sa] = np.repeat(heads, size)
        big = np.repeat(size > 1, size)
        slots = np.flatnonzero(big)
        suffix = sa[slots]
        if h >= depth or not len(slots):
            sa[slots] = np.sort(rank[suffix] * n + suffix) % n
            return sa, packed
        later = np.where(suffix + h < end[suffix], rank[np.minimum(suffix + h, n - 1)], -1)
        key = rank[suffix] * (n + 1) + later + 1
        order = np.argsort(key)
        sa[slots] = suffix[order]
        key = key[order]
        new[slots[1:]] |= key[1:] != key[:-1]
        h *= 2


def common_prefixes(sa: np.ndarray, packed: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each place in the suffix array the common prefix with the place before, by Kasai's rule.

    A suffix shares at least one byte less than the one that begins one byte earlier. The rule runs along all pieces at
    once, comparing 8 bytes at a time. first: beginnings of the pieces.
    """
    n = len(sa)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.where(rank > 0, sa[rank - 1], -1)
    lcp = np.zeros(n, np.int64)
    pos, known = first.copy(), np.zeros(len(first), np.int64)
    while len(pos):
        other = before[pos]
        most = np.where(other >= 0, np.minimum(end[pos] - pos, end[other] - other), 0)
        known = np.minimum(known, most)
        todo = np.flatnonzero(known < most)
        while len(todo):
            a, b = packed[pos[todo] + known[todo]], packed[other[todo] + known[todo]]
            diff = a ^ b
            same = np.where(diff == 0, 8, 0)
            odd = np.flatnonzero(diff)
            if len(odd):
                bits = np.frexp(np.maximum(diff[odd] >> np.uint64(11), 1).astype(np.float64))[1] + 11
                low = diff[odd] >> np.uint64(11) == 0
                same[odd] = np.where(low, 6, (64 - bits) // 8)
                for i in odd[np.flatnonzero(low)]:
                    same[i] = 8 - (int(diff[i]).bit_length() + 7) // 8
            known[todo] = np.minimum(known[todo] + same, most[todo])
            todo = todo[(same == 8) & (known[todo] < most[todo])]
        lcp[rank[pos]] = known
        pos, known = pos + 1, np.maximum(known - 1, 0)
        live = pos < end[pos - 1]
        pos, known = pos[live], known[live]
    return lcp
