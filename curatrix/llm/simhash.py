"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of
their eight bytes, so they share at least six positional bytes: that is the
guaranteed minimum of the count filter. The posting list of one single byte would
hold a 256th of everything and give quadratic pairs, so a posting here is named by six
positional bytes at once (28 ways to choose them): whoever meets in a posting has
already reached the minimum, and a posting holds at most 65,536 different
fingerprints, because only two bytes are left free.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import ASCII_LOWER, raw, rows, spans, written
from curatrix.operators.components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
BYTES = 8


def _hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, len(words))
    starts, ends = spans(words)
    digest = xxhash.xxh64_intdigest
    made = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())]
    return np.array(made, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as a signed 64-bit number; zero without hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of all shingle hashes, as a signed 64-bit number; no words give zero."""
    return majority(_hashes(text or b"", shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED) -> DataFrame:
    """(id, fp) of every row; nothing is shuffled. Null and empty texts have fingerprint zero."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint_of(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw")).mapInArrow(
        hashed, "doc_id long, fp long")


def links_within(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one posting.

    The bytes that a posting leaves free take few values, so neighbours are found by
    flipping every choice of up to ``distance`` bits that vary at all and looking the
    results up: work grows with the posting, not with its square.
    """
    values = np.unique(values.astype(np.int64).view(np.uint64))
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [1 << b for b in range(64) if varying >> b & 1]
    root = np.arange(len(values))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in range(1, distance + 1):
        for chosen in combinations(bits, k):
            flipped = values ^ np.uint64(sum(chosen))
            at = np.minimum(np.searchsorted(values, flipped), len(values) - 1)
            # Each pair is met from both sides; the smaller side counts.
            for i in np.flatnonzero((values[at] == flipped) & (values < flipped)).tolist():
                a, b = find(i), find(int(at[i]))
                if a != b:
                    root[max(a, b)] = min(a, b)
    signed = values.view(np.int64)
    return [(int(signed[find(i)]), int(signed[i])) for i in range(len(values)) if find(i) != i]


def postings(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fps) of every posting with at least two different fingerprints."""
    kept = BYTES - distance
    choices = []
    for free in combinations(range(BYTES), BYTES - kept):
        mask = sum(0xFF << 8 * b for b in range(BYTES) if b not in free)
        choices.append(mask - (1 << 64) if mask >> 63 else mask)
    masks = F.array(*[F.lit(m).cast("long") for m in choices])
    keyed = fps.select("fp", F.posexplode(masks).alias("choice", "mask")).select(
        "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")
    return keyed.groupBy("choice", "shared").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1").select("fps")


def near_links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints at most ``distance`` bits apart.

    Of each posting a spanning forest of its verified links is given, so the output grows with
    the postings, never with the square of a cloud of near copies.
    """
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pair for values in batch.column(0).to_pylist() for pair in links_within(np.array(values), distance)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return postings(fps, distance).mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, the row's own included. Equal
    fingerprints are always linked; null and empty texts share fingerprint zero and are linked like any other.
    Repeated rows each get a row. A row with a null id gets its text's component; where nobody in a
    component has an id, ``component_id`` is null. Extra columns are not read.
    """
    hashed = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fps")
    labels = connected_components(near_links(distinct, distance))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named-fps")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = named.join(smallest, "component").select("fp", "component_id")
    return hashed.join(groups, "fp").select("doc_id", "fp", "component_id")

