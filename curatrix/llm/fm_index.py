"""FM-index over a sequence of small numbers: wavelet-tree ranks and sampled suffix positions, in numpy."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; ``text`` must have no two equal suffixes."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:-width or None] = rank[width:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[0] = 0
        np.cumsum(key[order[1:]] != key[order[:-1]], out=fresh[1:])
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, bit by bit from the highest (as a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.n_bits, self.ones, self.zeros = n_bits, [], []
        for level in range(n_bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros_like(at), at.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            set_ = (symbol >> (self.n_bits - 1 - level) & 1).astype(bool)
            low = np.where(set_, zeros + ones[low], low - ones[low])
            high = np.where(set_, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """Segments of symbols (1 and up); matches never cross the end of a segment."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        """``ends``: the segments' ends in ``symbols``; an end mark is put behind each."""
        text = np.insert(symbols.astype(np.int64), ends, 0)
        marks = ends + np.arange(len(ends))
        #: End marks differ from each other, so that comparing suffixes stops at the end of a segment.
        order = text + len(marks)
        order[marks] = np.arange(len(marks))
        suffixes = suffix_array(order)
        self.before = text[suffixes - 1]
        counts = np.bincount(text, minlength=int(text.max()) + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletTree(self.before, max(1, int(text.max()).bit_length()))
        #: Heads of segments are samples too, so that no walk has to step over an end mark.
        self.sampled = (suffixes % SAMPLE == 0) | (self.before == 0)
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]
        self.starts = np.concatenate([[0], marks[:-1] + 1])
        self.largest = int(text.max())

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order, from ``low`` to ``high``, that begin with each pattern (all of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.where((patterns > self.largest).any(axis=1), 0, len(self.before))
        for symbol in np.minimum(patterns, self.largest).T[::-1]:
            low = self.first[symbol] + self.tree.rank(symbol, low)
            high = self.first[symbol] + self.tree.rank(symbol, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``symbols`` of rows: steps back through the text to the next sampled suffix."""
        at, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        walking = np.arange(len(rows))
        while len(walking):
            hit = self.sampled[at[walking]]
            done, walking = walking[hit], walking[~hit]
            found[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            symbol = self.before[at[walking]]
            at[walking] = self.first[symbol] + self.tree.rank(symbol, at[walking])
            steps[walking] += 1
        return found - np.searchsorted(self.starts, found, side="right") + 1
