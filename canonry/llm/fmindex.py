"""A compressed full-text index over word sequences.

The Burrows-Wheeler transform of the concatenated sequences is kept in a wavelet
matrix of packed bits with a count for every 64 of them, one and a half bits a
symbol and level.  Backward search narrows the interval of suffixes that begin
with a pattern while the pattern grows to the left; many patterns are searched
at once.  A sequence that stands for several equal ones has their number as its
weight, and an interval counts the weights of the suffixes in it.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_LOW6 = np.uint64(63)


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)
        self.zeros = n - int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        block = i >> 6
        low = (_ONE << (i.astype(np.uint64) & _LOW6)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class FMIndex:
    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, width: int = 1):
        """``width``: what ``repeated_windows`` will be asked for, at least."""
        self.sizes = sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint32)
        self.alphabet, dense = np.unique(flat, return_inverse=True)
        n, m = int(sizes.sum()) + len(sizes), len(sizes)
        #: Separators are 0; words from 1 on.
        self.text = np.zeros(n, np.int64)
        is_word = np.ones(n, bool)
        is_word[self.starts + sizes] = False
        self.text[is_word] = dense + 1
        # As suffixes, separators are told apart by their place.
        rank = self.text + m - 1
        rank[~is_word] = np.arange(m)
        each = np.repeat(weights, sizes + 1)
        suffixes = self._suffixes(rank, each, width)
        #: Weight of all suffixes before each place of their order.
        self.weight = np.concatenate([[0], np.cumsum(each[suffixes])])
        bwt = self.text[suffixes - 1]
        count = np.bincount(self.text, minlength=len(self.alphabet) + 1)
        #: Suffixes that begin with a smaller symbol.
        self.smaller = np.cumsum(count) - count
        self.levels = max(1, int(len(self.alphabet)).bit_length())
        self.bits = []
        for level in range(self.levels - 1, -1, -1):
            bit = (bwt >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.n = n
        symbols = np.arange(len(self.alphabet) + 1)
        self.origin = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _suffixes(self, rank: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """Suffix array by prefix doubling.  On the way, ``some`` tells the sequences
        that hold a repeated stretch of the greatest power of two up to ``width``."""
        n, size = len(rank), 1
        may = np.ones(n, bool)
        while True:
            second = np.zeros(n, np.int64)
            second[:-size] = rank[size:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            size *= 2
            if size <= width:
                may = np.bincount(rank, weights)[rank] >= 2
            if new[-1] == n - 1:
                self.some = np.logical_or.reduceat(may, self.starts)
                return order

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.levels - 1, -1, -1), self.bits, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the transform."""
        return self._descend(symbol, i) - self.origin[symbol]

    def repeated_back_to(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each stretch of the text, the least f so that text[f + 1 : end + 1]
        weighs two at least, where f >= begin - 1."""
        at = end.copy()
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        live = np.arange(len(end))
        while len(live):
            s = self.text[at[live]]
            pair = self.rank(np.concatenate([s, s]), np.concatenate([low[live], high[live]]))
            lo, hi = self.smaller[s] + pair[: len(s)], self.smaller[s] + pair[len(s) :]
            go = self.weight[hi] - self.weight[lo] >= 2
            live = live[go]
            low[live], high[live] = lo[go], hi[go]
            at[live] -= 1
            live = live[at[live] >= begin[live]]
        return at

    def repeated_windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of windows of ``width`` symbols that weigh two at least, as
        sequence, first and last window, by matching statistics of every sequence that
        may hold one, from the right: a stretch that fails at f rules out every window
        around it.
        Intervals of one sequence may overlap."""
        end = self.starts + self.sizes - 1
        live = np.flatnonzero((self.sizes >= width) & self.some)
        found = []
        while len(live):
            b, e = self.starts[live], end[live]
            f = self.repeated_back_to(b, e)
            some = e - f >= width
            found.append(np.stack([live, f + 1 - b, e - width + 1 - b])[:, some])
            end[live] = np.minimum(e - 1, f + width - 1)
            live = live[(f >= b) & (end[live] - b >= width - 1)]
        which, first, last = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        order = np.argsort(which, kind="stable")
        return which[order], first[order], last[order]
