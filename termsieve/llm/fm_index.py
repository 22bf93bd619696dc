"""FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform with backward search."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into 64-bit words with a running count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Set bits in front of each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for shift in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bits = (symbols >> shift & 1).astype(np.uint8)
            self.levels.append((shift, BitVector(bits)))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        every = np.arange(n_symbols)
        self.start = self._descend(every, np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in front of its position."""
        return self._descend(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of texts for patterns of up to `window` + 1 words.

    `text` holds symbols from 1 with 0 after each text. Suffixes are sorted by more words than a pattern has,
    which is all that backward search of such patterns needs.
    """

    def __init__(self, text: np.ndarray, window: int):
        n, rank, length = len(text), text.astype(np.int64), 1
        self.n_symbols = int(text.max()) + 1
        part = None
        while length <= window:
            if 2 * length > window:
                part = (length, rank)
            rank, length = self._doubled(rank, length), 2 * length
        order = np.argsort(rank, kind="stable")
        half, half_rank = part
        alike = half_rank * (n + 1) + self._shifted(half_rank, window - half)
        fresh = np.concatenate(([True], np.diff(alike[order]) != 0))
        self.order = order
        self.first = np.flatnonzero(fresh)  # of every group of suffixes that begin with the same `window` words
        self.last = np.concatenate((self.first[1:], [n]))
        self.group = np.cumsum(fresh) - 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.n_symbols))))
        self.transform = WaveletMatrix(text[order - 1].astype(np.int64), self.n_symbols)

    @staticmethod
    def _shifted(rank: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((rank[by:], np.zeros(min(by, len(rank)), rank.dtype)))

    def _doubled(self, rank: np.ndarray, length: int) -> np.ndarray:
        key = rank * (int(rank.max()) + 1) + self._shifted(rank, length)
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate(([True], np.diff(key[order]) != 0)))
        return new

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after putting a symbol in front of each pattern."""
        at = self.below[symbol]
        both = self.transform.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return at + both[:len(at)], at + both[len(at):]


def matches(index: FMIndex, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int):
    """For texts streamed through the index, from the end of each: yields (which texts, where in them a window
    starts, its group of suffixes) for all windows that occur, that is, where the matching statistic reaches
    `window`. A text whose pattern does not occur drops out; longer patterns are cut back to `window` words.
    """
    todo = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(todo), np.int64), np.full(len(todo), len(text), np.int64)
    for step in range(int(sizes.max(initial=0))):
        going = (sizes[todo] > step) & (high > low)
        todo, low, high = todo[going], low[going], high[going]
        if not len(todo):
            return
        at = sizes[todo] - 1 - step
        low, high = index.extend(text[starts[todo] + at], low, high)
        if step + 1 > window:
            group = index.group[np.minimum(low, len(text) - 1)]
            low, high = np.where(high > low, index.first[group], low), np.where(high > low, index.last[group], high)
        if step + 1 >= window:
            hit = high > low
            yield todo[hit], at[hit], index.group[low[hit]]
