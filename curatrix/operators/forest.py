"""Who belongs together among near fingerprints, without listing pairs: a spanning forest from each bucket.

Buckets are those of ``fingerprint_pairs``. A bucket gives at most one edge less than it has fingerprints, however many of its pairs
are near, so a cloud of n different hashes is 56 n edges at most, and never n * n / 2 pairs. A crowded bucket is cut in tiles, and each pair
of tiles gives a forest of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions.bits import band_keys
from curatrix.operators.neardup import HOT_BUCKET, fingerprint_cells
from curatrix.session import materialize

#: Buckets up to this size are compared as one small matrix.
SMALL = 48
#: Bits for the number of a tile.
TILE_BITS = 24


def linked(fp: np.ndarray, group: np.ndarray, fps: np.ndarray, groups: np.ndarray, distance: int) -> np.ndarray:
    """Near, and not both in one and the same group. ``group`` is a bit mask of the groups that hold the fingerprint."""
    apart = (groups != group) | (groups & (groups - 1) != 0)
    return (np.bitwise_count(fps ^ fp) <= distance) & apart


def worth_opening(fps: np.ndarray, groups: np.ndarray, sizes: np.ndarray, distance: int) -> np.ndarray:
    """Which buckets, lying one after the other, are large or have a near pair: each value of a small one is held against those behind it, all buckets at once."""
    found = sizes > SMALL
    owner = np.repeat(np.arange(len(sizes)), sizes)
    behind = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(fps)) - 1
    rows, step = np.flatnonzero(~found[owner] & (behind > 0)), 1
    while len(rows):
        near = linked(fps[rows], groups[rows], fps[rows + step], groups[rows + step], distance)
        found[owner[rows[near]]] = True
        step += 1
        rows = rows[behind[rows] >= step]
    return np.flatnonzero(found)


def bucket_forest(fps: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a spanning forest. What was reached is compared no more, so a dense cloud costs few comparisons for each member."""
    none = np.empty(0, np.int64)
    if len(fps) <= SMALL and not np.triu(linked(fps[:, None], groups[:, None], fps[None, :], groups[None, :], distance), 1).any():
        return none, none
    rest, source, target = np.arange(len(fps)), [none], [none]
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            at = waiting.pop()
            near = linked(fps[at], groups[at], fps[rest], groups[rest], distance)
            found = rest[near]
            if len(found):
                source.append(np.full(len(found), at))
                target.append(found)
                waiting.extend(found.tolist())
                rest = rest[~near]
    return np.concatenate(source), np.concatenate(target)


def near_forest(fps: DataFrame, distance: int = cv.NEAR_DUP_DISTANCE, blocks: int = 8, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): edges between near fingerprints of ``fps(fp, groups)`` that connect exactly what all their pairs connect.

    ``fp`` is distinct. Pairs of which both are in one and the same group alone do not count; give every row its own bits, as 3, to link all. A task
    holds at most two tiles of ``hot_bucket`` fingerprints.
    """
    keyed = fps.select("fp", F.col("groups").cast("long").alias("groups"), F.explode(band_keys("fp", distance, blocks)).alias("k")).select(
        "fp", "groups", "k.combo", "k.value")
    # How crowded a bucket is only decides into how many tiles it is cut, so a fixed share of the fingerprints tells it.
    probe = max(1, hot_bucket // 200)
    tiles = materialize(keyed.where(F.pmod(F.xxhash64("fp"), F.lit(probe)) == 0).groupBy("combo", "value").agg(
        F.ceil(2 * probe * F.count(F.lit(1)) / hot_bucket).cast("int").alias("tiles")).where("tiles > 1"), "tiles")
    cut = keyed.join(tiles, ["combo", "value"]).withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least("tile", other).alias("row"), F.greatest("tile", other).alias("col")))
    # Nearly all buckets have one tile, and their rows nothing to open.
    single = keyed.join(tiles, ["combo", "value"], "left_anti").select(F.expr(f"combo * {1 << 2 * TILE_BITS}L").alias("place"), "value", "fp", "groups")
    opened = single.unionByName(cut.select("combo", "value", "fp", "groups", F.explode(pair).alias("at")).select(
        F.expr(f"combo * {1 << 2 * TILE_BITS}L + at.row * {1 << TILE_BITS}L + at.col").alias("place"), "value", "fp", "groups"))
    # Buckets come as runs of sorted rows, most of them of a single fingerprint, rather than as lists that an aggregation builds.
    buckets = opened.repartition("place", "value").sortWithinPartitions("place", "value")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            fps, groups, out = rows[2], rows[3], [np.empty((2, 0), np.int64)]
            sizes = np.diff(starts, append=rows.shape[1])
            for k in worth_opening(fps.view(np.uint64), groups, sizes, distance):
                own = slice(starts[k], starts[k] + sizes[k])
                out.append(fps[own][np.stack(bucket_forest(fps[own].view(np.uint64), groups[own], distance))])
            a, b = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        rest = np.empty((4, 0), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            starts = np.flatnonzero((rows[:2, 1:] != rows[:2, :-1]).any(axis=0)) + 1
            # The last bucket may go on in the next batch.
            whole = starts[-1] if len(starts) else 0
            rest = rows[:, whole:]
            if whole:
                yield found(rows[:, :whole], np.concatenate([[0], starts[:-1]]))
        if rest.shape[1]:
            yield found(rest, np.zeros(1, np.int64))

    return buckets.mapInArrow(edges, "a long, b long").distinct()


def split_mask(mask: Column, splits: Sequence[str] = cv.SPLITS, classes: Sequence[str] = cv.CLASSES) -> Column:
    """Bits of the splits in a mask of (split, class) cells."""
    width = len(classes)
    return sum((F.when(mask.bitwiseAND(F.lit(((1 << width) - 1) << width * k)) != 0, 1 << k).otherwise(0) for k in range(len(splits))), F.lit(0))


def cross_split_forest(items: DataFrame, distance: int = cv.NEAR_DUP_DISTANCE, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Fingerprints that near-duplicates across splits touch, and the edges between them: (fp) and (a, b).

    ``items``: item_id, split, class, fp. Rows of other splits or classes than the known ones, and null fingerprints, are left out.
    """
    fps = materialize(fingerprint_cells(items).select("fp", split_mask(F.col("mask")).alias("groups")).where("groups > 0"), "split-masks")
    forest = materialize(near_forest(fps, distance, hot_bucket=hot_bucket), "forest")
    touched = forest.select(F.col("a").alias("fp")).unionByName(forest.select(F.col("b").alias("fp"))).unionByName(
        fps.where("bit_count(groups) > 1").select("fp")).distinct()
    return touched, forest
