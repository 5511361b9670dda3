"""Isotonic regression: pool adjacent violators as a merge of block stacks over range partitions.

Each task pools the blocks of one range. Pooling is associative: blocks that violate
the order only across two ranges are pooled in a later round, whose ranges have other
bounds (one range more in every other round). Rounds end when no neighbours violate
the order. A round is a written table of blocks; the driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.session import materialize

#: Blocks that one task pools, and distinct scores that one task maps.
TASK_ROWS = 1_000_000

_BLOCK = "lo double, hi double, w double, wy double"


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of one range in order: a block whose mean is not above that of the block before joins it."""
    los, his, ws, wys = [], [], [], []
    for batch in batches:
        for lo, hi, w, wy in zip(*(batch[c].tolist() for c in ("lo", "hi", "w", "wy"))):
            while ws and wys[-1] * w >= wy * ws[-1]:
                lo, w, wy = los.pop(), ws.pop() + w, wys.pop() + wy
                his.pop()
            los.append(lo)
            his.append(hi)
            ws.append(w)
            wys.append(wy)
    yield pd.DataFrame({"lo": los, "hi": his, "w": ws, "wy": wys, "part": np.full(len(los), TaskContext.get().partitionId(), "int32")})


def _ends(blocks: DataFrame) -> DataFrame:
    """First and last block of every range: as many rows as there were tasks."""
    cell = F.struct("lo", "w", "wy")
    return blocks.groupBy("part").agg(F.min_by(cell, "lo").alias("first"), F.max_by(cell, "lo").alias("last"))


def _mean(cell: str) -> Column:
    return F.col(f"{cell}.wy") / F.col(f"{cell}.w")


def fit(df: DataFrame, score: str, label: str, weight: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Blocks ``lo, hi, n, p, next_lo, next_p`` of the monotone map from score to mean label.

    Rows with a null or NaN score or label, or a weight that is not positive, are left
    out. Equal scores are one point. Neighbouring blocks of equal means are one block.
    No rows give no blocks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(score).cast("double").alias("lo"), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("lo is not null and y is not null and not isnan(lo) and not isnan(y) and w > 0")
    blocks = materialize(rows.groupBy("lo").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).select(
        "lo", F.col("lo").alias("hi"), "w", "wy"), "scores")
    for turn in count():
        tasks = max(1, -(-blocks.count() // task_rows))
        tasks += turn % 2 if tasks > 1 else 0
        ranges = blocks.select("lo", "hi", "w", "wy").repartitionByRange(tasks, "lo").sortWithinPartitions("lo")
        blocks = materialize(ranges.mapInPandas(_pool, f"{_BLOCK}, part int"), "blocks")
        ends = _ends(blocks).select("part", "first", F.lag("last").over(Window.orderBy("first.lo")).alias("before"))
        if ends.where(_mean("before") >= _mean("first")).isEmpty():
            break
    inside = Window.partitionBy("part").orderBy("lo")
    following = _ends(blocks).select("part", F.lead("first").over(Window.orderBy("first.lo")).alias("after"))
    p = F.col("wy") / F.col("w")
    known = blocks.select("part", "lo", "hi", F.col("w").alias("n"), p.alias("p"),
                          F.lead("lo").over(inside).alias("_lo"), F.lead(p).over(inside).alias("_p"))
    return known.join(F.broadcast(following), "part").select(
        "lo", "hi", "n", "p", F.coalesce("_lo", "after.lo").alias("next_lo"), F.coalesce("_p", _mean("after")).alias("next_p"))


def apply(blocks: DataFrame, df: DataFrame, score: str, out: str = "p_iso", task_rows: int = TASK_ROWS) -> DataFrame:
    """Every row with its mean: that of its block, between blocks on the line from one to the next, beyond the ends that of the end.

    A null or NaN score, or no blocks at all, gives null. Distinct scores are dealt into
    ranges of their own quantiles, a block goes to every range it reaches into.
    """
    z = F.col(score).cast("double")
    distinct = materialize(df.select(z.alias("z")).where("z is not null and not isnan(z)").distinct(), "distinct-scores")
    tasks = -(-distinct.count() // task_rows)
    steps = [i / tasks for i in range(1, tasks)]
    cuts = sorted(set(distinct.approxQuantile("z", steps, 0.2 / tasks))) if steps else []
    dealt = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="z", outputCol="_range") if cuts else None

    def ranged(frame: DataFrame, column: str, name: str) -> DataFrame:
        if dealt is None:
            return frame.withColumn(name, F.lit(0))
        return dealt.transform(frame.withColumn("z", F.col(column))).withColumn(name, F.col("_range").cast("int")).drop(
            "_range", *([] if column == "z" else ["z"]))

    start = F.when(F.col("lo") == F.lit(blocks.agg(F.min("lo")).first()[0]), F.lit(float("-inf"))).otherwise(F.col("lo"))
    reach = blocks.withColumns({"_start": start, "_end": F.coalesce("next_lo", F.lit(float("inf")))})
    reach = ranged(ranged(reach, "_start", "_a"), "_end", "_b").withColumn("range", F.explode(F.sequence("_a", "_b")))
    scores = ranged(distinct, "z", "range")

    def look_up(points: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(found):
            return pd.DataFrame({"z": points["z"], out: np.nan if len(points) else []}).astype("float64").replace(np.nan, None)
        found = found.sort_values("lo")
        at = np.maximum(np.searchsorted(found["lo"].to_numpy(), points["z"].to_numpy(), "right") - 1, 0)
        b, x = found.iloc[at].reset_index(drop=True), points["z"].reset_index(drop=True)
        between = (x > b["hi"]) & b["next_lo"].notna()
        share = ((x - b["hi"]) / (b["next_lo"] - b["hi"])).where(between, 0.0)
        return pd.DataFrame({"z": x, out: b["p"] + share * (b["next_p"] - b["p"]).where(between, 0.0)})

    mapped = scores.groupBy("range").cogroup(reach.select("range", "lo", "hi", "p", "next_lo", "next_p").groupBy("range")).applyInPandas(
        look_up, f"z double, `{out}` double")
    mapped = mapped.withColumnRenamed("z", "_z")
    return df.join(mapped, z == F.col("_z"), "left").drop("_z")
