"""Suffix order and previous factors of byte texts, in numpy: which windows also start at an earlier or a later place."""

from __future__ import annotations

import numpy as np


def suffix_ranks(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` (sorted) by their first ``depth`` bytes; equal ranks: equal bytes.

    Prefix doubling: a suffix's rank by twice as many bytes follows from two ranks. Each start has ``depth`` bytes after it.
    A level ranks only the places that a later one asks for.
    """
    n = len(text)
    bits = max(1, int(n).bit_length())
    values = np.unique(text)
    code = np.zeros(256, np.uint64)
    code[values] = np.arange(1, len(values) + 1, dtype=np.uint64)
    per = len(values).bit_length()
    size = max(1, min(depth, (64 - bits) // per))
    sizes = [size]
    while sizes[-1] < depth:
        sizes.append(min(depth, 2 * sizes[-1]))
    asked = [starts]                                      # places of the last level, then of the ones before it
    for small, large in zip(sizes[-2::-1], sizes[:0:-1], strict=True):
        need = np.zeros(n + 1, bool)
        need[asked[-1]] = True
        need[asked[-1] + (large - small)] = True
        asked.append(np.flatnonzero(need))
    at = asked.pop()
    symbol = code[text]
    key = np.zeros(len(at), np.uint64)
    for k in range(sizes[0]):
        key = (key << np.uint64(per)) | symbol[at + k]
    rank = np.zeros(n, np.uint64)
    rank[at] = _ranked(key, np.arange(len(at)), bits)
    for small, large in zip(sizes[:-1], sizes[1:], strict=True):
        at = asked.pop()
        a, b = rank[at], rank[at + (large - small)]
        # both ranks and the place fit a word: sorting it is several times faster than sorting places by a key
        rank[at] = _ranked((a << np.uint64(bits)) | b, np.arange(len(at)), bits)
    return rank[starts].astype(np.int64)


def _ranked(key: np.ndarray, index: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of the keys."""
    if not len(key):
        return key
    if int(key.max()).bit_length() + bits <= 64:
        packed = np.sort((key << np.uint64(bits)) | index.astype(np.uint64))
        order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        sorted_key = packed >> np.uint64(bits)
    else:
        order = np.argsort(key)
        sorted_key = key[order]
    new = np.zeros(len(key), np.uint64)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(key), np.uint64)
    out[order] = np.cumsum(new, dtype=np.uint64)
    return out


def nearest_smaller(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order: the nearest one before with a smaller place (-1: none), and the least common prefix on the
    way there; ``common[i]`` is that of suffixes i - 1 and i. Pointers jump over places already passed by others."""
    n = len(place)
    to, least = np.arange(n) - 1, common.copy()
    live = np.flatnonzero(to >= 0)
    while len(live):
        live = live[(least[live] > 0) & (place[to[live]] >= place[live])]
        hop = to[live]
        # the jumps of a round read the pointers of the round before
        least[live], to[live] = np.minimum(least[live], least[hop]), to[hop]
        out = to[live] < 0
        least[live[out]] = 0
        live = live[~out]
    least[to < 0] = 0
    return to, least


def factors(rank: np.ndarray, place: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes with ranks by their first ``depth`` bytes and different places: the longest previous and the longest
    next factor, counted as ``depth`` from there on and as 0 below.

    The previous and next smaller places in suffix order are the only candidates for the longest factor that starts
    earlier; with the places reversed, for the one that starts later.
    """
    order = np.lexsort((place, rank))
    r, p = rank[order], place[order]
    common = np.zeros(len(r), np.int64)
    common[1:] = np.where(r[1:] == r[:-1], depth, 0)
    behind = np.append(0, common[:0:-1]) if len(r) else common        # the same from the other end
    out = []
    for key in (p, -p):
        left = nearest_smaller(key, common)[1]
        right = nearest_smaller(key[::-1], behind)[1][::-1]
        best = np.empty(len(r), np.int64)
        best[order] = np.maximum(left, right)
        out.append(best)
    return out[0], out[1]
