"""Recompression of a token sequence: rounds that name runs and pairs, the same everywhere.

A round first makes every maximal run of one symbol a symbol, then pairs every symbol of the left class with a
following symbol of the right class. Names and classes are hashes of content, so all tasks give equal
substrings the same symbols without asking each other. Each symbol carries the words it stands for and its context:
the words that decided that it came to be. Wherever that context occurs again, the symbol occurs again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from curatrix.llm.common import mix

#: Context that reaches over an end of the document, so that it is no property of the words alone.
OPEN = 1 << 40


@dataclass
class Symbols:
    """Symbols of one sequence, in order: name, words [start, end) and context [low, high)."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __len__(self) -> int:
        return len(self.name)


def letters(words: np.ndarray) -> Symbols:
    at = np.arange(len(words), dtype=np.int64)
    return Symbols(words, at, at + 1, at, at + 1)


def _joined(s: Symbols, first: np.ndarray, last: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
    """Blocks of symbols (first to last, both included) as one symbol each."""
    return Symbols(name, s.start[first], s.end[last], np.minimum(low, s.low[first]), np.maximum(high, s.high[last]))


def _neighbours(s: Symbols, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of the symbols beside each block; open at the ends of the sequence."""
    low = np.where(first > 0, s.low[first - 1], -OPEN)
    high = np.where(last + 1 < len(s), s.high[np.minimum(last + 1, len(s) - 1)], OPEN)
    return low, high


def name_runs(s: Symbols, salt: int) -> Symbols:
    """Every maximal run becomes a symbol; its context holds the neighbours that end it."""
    if not len(s):
        return s
    first = np.flatnonzero(np.concatenate([[True], s.name[1:] != s.name[:-1]]))
    last = np.append(first[1:], len(s)) - 1
    count = (last - first + 1).astype(np.uint64)
    name = np.where(count > 1, mix(mix(s.name[first] + np.uint64(salt)) + count), s.name[first])
    return _joined(s, first, last, name, *_neighbours(s, first, last))


def name_pairs(s: Symbols, salt: int) -> Symbols:
    """Left-class symbols join right-class followers; the others' context holds the neighbour they looked at."""
    if not len(s):
        return s
    right = (mix(s.name ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
    opens = ~right[:-1] & right[1:]
    opens = np.append(opens, False)
    follows = np.concatenate([[False], opens[:-1]])
    first = np.flatnonzero(~follows)
    paired = opens[first]
    last = first + paired
    name = np.where(paired, mix(mix(s.name[first] + np.uint64(salt)) + s.name[last]), s.name[first])
    low, high = _neighbours(s, first, last)
    # A pair is decided by its two symbols; a lone left symbol by its follower, a lone right one by what precedes it.
    own_low, own_high = s.low[first], s.high[last]
    return _joined(s, first, last, name, np.where(~paired & right[first], low, own_low), np.where(~paired & ~right[first], high, own_high))


def parse(words: np.ndarray, rounds: int) -> list[Symbols]:
    """The symbols after each round."""
    out, s = [], letters(words)
    for k in range(1, rounds + 1):
        s = name_pairs(name_runs(s, 2 * k), 2 * k + 1)
        out.append(s)
    return out
