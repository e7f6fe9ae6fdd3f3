"""A compressed FM-index over a sequence of symbols, in numpy: wavelet matrix of the BWT, backward search for many
patterns at once."""

from __future__ import annotations

import numpy as np

DEPTH = 32                   # suffixes are ordered by so many symbols; patterns may be as long


class BitRank:
    """A bit vector, 64 to a word, that counts the ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Of symbols 0 (a separator) to max; each pattern's occurrences are a range of the sorted suffixes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n = n
        self.order = suffix_order(text)
        bwt = text[self.order - 1]           # of the suffix at 0 it is the last symbol, a separator
        top = int(text.max()) if n else 0
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.levels = max(1, top.bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1 == 1
            self.bits.append(BitRank(bit))
            self.zeros.append(int(n - bit.sum()))
            bwt = np.concatenate((bwt[~bit], bwt[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the BWT."""
        a, b = np.zeros_like(i), i
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            ra, rb = bits.ones(a), bits.ones(b)
            a, b = np.where(one, zeros + ra, a - ra), np.where(one, zeros + rb, b - rb)
        return b - a

    def matching(self, text: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each ``end`` (inclusive) of ``text``: matched length, at most ``length``, up to which
        the pattern stands at two or more places of the index, and the range of suffixes there."""
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n)
        matched = np.zeros(len(end), np.int64)
        live = np.arange(len(end))
        for t in range(length):
            symbol = text[end[live] - t]
            a = self.less[symbol] + self.rank(symbol, lo[live])
            b = self.less[symbol] + self.rank(symbol, hi[live])
            more = b - a >= 2
            live = live[more]
            if not len(live):
                break
            lo[live], hi[live] = a[more], b[more]
            matched[live] = t + 1
        return matched, lo, hi


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order of their first DEPTH symbols, ties by position, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while size < DEPTH:
        then = np.zeros(n, np.int64)
        then[:max(0, n - size)] = rank[size:] + 1
        pair = rank * (n + 1) + then
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, sorted_pair[1:] != sorted_pair[:-1])) - 1 if n else 0
        size *= 2
    return np.argsort(rank, kind="stable")
