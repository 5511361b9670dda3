"""Smallest distance between items that share a name."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions.bits import hamming, sql_long
from curatrix.operators.neardup import HOT_BUCKET, fingerprint_pairs
from curatrix.operators.profile import spanning_by_key
from curatrix.operators.skew import lookup_join
from curatrix.session import materialize


#: Fingerprints of a stem that are compared directly once none of them is within ``distance``.
FEW = 2_000
#: Flips tried in each quarter of a fingerprint, step by step: within 4 (f + 1) - 1 bits, one of the four quarters has at most f flips.
FLIPS = (1, 2)
QUARTER = 16


def _flip_masks(quarter: int, flips: int) -> list[int]:
    """Every change of at most ``flips`` bits in one quarter."""
    return [sum(1 << (QUARTER * quarter + b) for b in chosen) for k in range(flips + 1) for chosen in combinations(range(QUARTER), k)]


def nearest_by_quarters(fps: DataFrame, stem: str, flips: int) -> DataFrame:
    """(stem, d): the smallest distance between fingerprints of a stem, where it is below 4 (flips + 1).

    Two fingerprints that near have a quarter in which they differ in ``flips`` bits at most, so one side is looked up under all such changes. A
    looked-up group is named by stem, quarter and its 16 bits: a stem that holds a third of everything is dealt over 4 * 65,536 groups.
    """
    parts = [sql_long(((1 << QUARTER) - 1) << QUARTER * q) for q in range(4)]
    exact = F.expr("array(" + ", ".join(f"named_struct('part', {q}, 'value', fp & {m})" for q, m in enumerate(parts)) + ")")
    tried = [f"transform(array({', '.join(sql_long(f) for f in _flip_masks(q, flips))}), x -> named_struct('part', {q}, 'value', (fp & {m}) ^ x))"
             for q, m in enumerate(parts)]
    stored = fps.select(stem, F.col("fp").alias("fp_a"), F.explode(exact).alias("k")).select(stem, "fp_a", "k.part", "k.value")
    asked = fps.select(stem, F.col("fp").alias("fp_b"), F.explode(F.expr(f"concat({', '.join(tried)})")).alias("k")).select(stem, "fp_b", "k.part", "k.value")
    met = asked.join(stored.hint("merge"), [stem, "part", "value"]).where("fp_a < fp_b")
    return met.groupBy(stem).agg(F.min(hamming(F.col("fp_a"), F.col("fp_b"))).cast("int").alias("d")).where(F.col("d") < 4 * (flips + 1))


def min_distance_by_stem(items: DataFrame, stem: str = "stem", first: int | None = None, distance: int = cv.NEAR_DUP_DISTANCE,
                         tile: int = HOT_BUCKET, few: int = FEW) -> DataFrame:
    """Per stem used in more than one split: items and smallest Hamming distance between two of them.

    The radius is raised step by step, and a stem leaves at its first hit: equal fingerprints (distance 0), pairs within ``distance`` by
    blocks, then, for stems with more than ``few`` distinct fingerprints, within 7 and 11 bits by quarters with flipped bits. What is then
    left has few fingerprints or has all of them 12 bits apart; they are compared in tiles of at most ``tile`` rows, folded to their
    minimum where they are made. A stem that many copies share ends in the first step.
    """
    reused = spanning_by_key(items, stem).select(stem, "n_items", "split_mask")
    if first is not None:
        reused = reused.orderBy(stem).limit(first)
    reused = materialize(reused, "stems")
    per_fp = items.where(F.col("fp").isNotNull()).groupBy(stem, "fp").agg(F.count(F.lit(1)).alias("n"))
    fps = materialize(lookup_join(per_fp, reused.select(stem, "n_items"), [stem], "n_items").drop("n_items"), "stem-fingerprints")
    found = [fps.where("n > 1").select(stem).distinct().withColumn("d", F.lit(0))]
    open_ = fps.join(found[0].select(stem), stem, "left_anti").select(stem, "fp")
    close = fingerprint_pairs(open_, distance, within=[stem], hot_bucket=tile).groupBy(stem).agg(F.min("distance").alias("d"))
    found.append(materialize(close, "stem-close"))
    open_ = open_.join(found[-1].select(stem), stem, "left_anti")
    large = materialize(open_.groupBy(stem).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few), "large-stems")
    for flips in FLIPS:
        if large.isEmpty():
            break
        wide = open_.join(large.select(stem), stem, "left_semi")
        found.append(materialize(nearest_by_quarters(wide, stem, flips), "stem-quarters"))
        open_ = open_.join(found[-1].select(stem), stem, "left_anti")
        large = materialize(large.join(found[-1].select(stem), stem, "left_anti"), "large-stems")
    tiles = open_.groupBy(stem).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    cut = open_.join(tiles, stem).withColumn("_tile", F.pmod(F.xxhash64("fp"), F.col("_tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = cut.select(stem, F.col("fp").alias("fp_a"), F.col("_tile").alias("_row"), every.alias("_col"))
    right = cut.select(stem, F.col("fp").alias("fp_b"), F.col("_tile").alias("_col"), every.alias("_row"))
    found.append(left.join(right.hint("merge"), [stem, "_row", "_col"]).where("fp_a < fp_b").groupBy(stem).agg(
        F.min(hamming(F.col("fp_a"), F.col("fp_b"))).cast("int").alias("d")))
    return reused.join(reduce(DataFrame.unionByName, found), stem, "left").select(stem, "n_items", F.col("d").alias("min_distance"))
