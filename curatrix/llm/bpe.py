"""Byte-level BPE by segment trees, for many pieces at once.

Each piece of a text (a match of the split pattern) has a segment tree over its byte positions. A leaf
holds the rank of the pair that begins there, a node the leftmost minimum below it (rank and position in one
number). A merge reads the root and makes three point updates of logarithmic cost: the merged pair, its
live neighbour to the left, and the position that goes. Pieces of similar size share one array
of trees, so that every step is done for thousands of pieces by numpy.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).max
#: Pieces that a worker remembers at most; beyond that it starts afresh (results do not depend on it).
REMEMBERED = 400_000
BATCH_CHARS = 1 << 21
TREE_CELLS = 1 << 17

ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
ENCODED_DDL = "doc_id long, ids array<int>, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: Unicode's White_Space. Python's own class also takes 1C to 1F, which are no spaces there.
SPACE_POINTS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Texts of code points below this one are split with plain character ranges, which is faster.
NARROW = 0x250


def _ranges(points: Iterable[int]) -> str:
    """Members of a character class, as ranges of code points."""
    spans: list[list[int]] = []
    for point in sorted(points):
        if spans and point == spans[-1][1] + 1:
            spans[-1][1] = point
        else:
            spans.append([point, point])
    return "".join(f"\\u{first:04x}-\\u{last:04x}" for first, last in spans)


def _spelt_out(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with its classes replaced by ranges, inside and outside of brackets."""
    out, inside = [], False
    for token in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if token in ("[", "]"):
            inside = token == "["
        if token in classes:
            token = classes[token] if inside else f"[{classes[token]}]"
        elif token == r"\S":
            token = f"[^{classes[r'\s']}]"
        out.append(token)
    return "".join(out)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Finds all matches of the pattern in a text, with white space as Unicode has it."""
    spaces = {r"\s": _ranges(SPACE_POINTS)}
    anything = regex.compile(_spelt_out(pattern, spaces)).findall
    used = set(regex.findall(r"\\p\{\w+\}", pattern))
    small = spaces | {c: _ranges(i for i in range(NARROW) if regex.match(c, chr(i))) for c in used}
    narrow = re.compile(_spelt_out(pattern, small)).findall
    beyond = re.compile(f"[^\\x00-{chr(NARROW - 1)}]").search
    return lambda text: anything(text) if beyond(text) else narrow(text)


class SegmentTrees:
    """Encoder and decoder for the ranks of one file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, splitter(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 24 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], NONE)
        self.pair_ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)
        self.known: dict[str, tuple[int, ...]] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Rank and position of pairs as one number; NONE where there is no such pair."""
        key = left << 24 | right
        found = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys.take(found) == key, self.pair_ranks.take(found) * size + at, NONE)

    def _merge_all(self, pieces: list[bytes], size: int) -> list[tuple[int, ...]]:
        """Ids of pieces of two to ``size`` bytes (a power of two); all arrays hold one row of cells for each piece."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        position = np.arange(size)
        inside = (position < lengths[:, None]).ravel()
        ids = np.zeros(n * size, np.int64)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after, before = np.tile(position + 1, n), np.tile(position - 1, n)
        trees = np.full((n, 2 * size), NONE)
        first = np.flatnonzero((position + 1 < lengths[:, None]).ravel())
        trees[first // size, size + first % size] = self._pair_rank(ids[first], ids[first + 1], first % size, size)
        width = size
        while width > 1:
            trees[:, width // 2:width] = np.minimum(trees[:, width:2 * width:2], trees[:, width + 1:2 * width:2])
            width //= 2
        tree = trees.ravel()

        def set_leaf(root: np.ndarray, leaf: np.ndarray, value: np.ndarray | int) -> None:
            node = leaf + size
            tree[root + node] = value
            width = size
            while width > 1:
                node, width = node >> 1, width >> 1
                below = root + 2 * node
                tree[root + node] = np.minimum(tree.take(below), tree.take(below + 1))

        row = np.flatnonzero(trees[:, 1] != NONE)
        while len(row):
            root, cell = row * 2 * size, row * size
            best = tree.take(root + 1)
            at = best % size
            gone = after.take(cell + at)
            merged = best // size
            ids[cell + at] = merged
            inside[cell + gone] = False
            set_leaf(root, gone, NONE)
            follow = after.take(cell + gone)
            after[cell + at] = follow
            value = np.full(len(row), NONE)
            some = np.flatnonzero(follow < lengths.take(row))
            here = cell[some] + follow[some]
            before[here] = at[some]
            value[some] = self._pair_rank(merged[some], ids.take(here), at[some], size)
            set_leaf(root, at, value)
            some = np.flatnonzero(at > 0)
            lead = before.take(cell[some] + at[some])
            set_leaf(root[some], lead, self._pair_rank(ids.take(cell[some] + lead), merged[some], lead, size))
            row = row[tree.take(root + 1) != NONE]
        flat, cuts = ids[inside].tolist(), np.cumsum(inside.reshape(n, size).sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *cuts], cuts)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that are not remembered yet."""
        by_size: dict[int, tuple[list[str], list[bytes]]] = {}
        known, ranks = self.known, self.ranks
        for piece in pieces:
            value = piece.encode()
            whole = ranks.get(value)
            if whole is not None:
                known[piece] = (whole,)
                continue
            size = len(value)
            names, values = by_size.setdefault(8 if size <= 8 else 16 if size <= 16 else 1 << (size - 1).bit_length(), ([], []))
            names.append(piece)
            values.append(value)
        for size, (names, values) in by_size.items():
            step = max(1, TREE_CELLS // size)
            for i in range(0, len(names), step):
                known.update(zip(names[i:i + step], self._merge_all(values[i:i + step], size)))

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        missing = set().union(*split).difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*split)
        self.learn(missing)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, pieces))) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _groups(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            ids.append(key)
            texts.append(text)
            size += len(text)
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids of the whole text, and the bytes that they decode to.

    ``ranks_path`` names a rank file that every executor has. Null is taken as an empty text, which has no ids. Special
    tokens are not known: their strings are ordinary text. Repeated rows each get a row; extra columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = SegmentTrees(read_ranks(ranks_path), pattern)
        for keys, texts in _groups(batches, BATCH_CHARS):
            ids = trees.encode_many(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(map(trees.decode, ids), pa.binary())],
                schema=ENCODED)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, ENCODED_DDL)
