"""Joins and running sums that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix.session import materialize

HEAVY_KEYS = 1000


def lookup_join(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, heavy: int | None = None) -> DataFrame:
    """Inner join of many ``rows`` with ``groups`` that hold one row per key.

    ``groups`` is written once, since it is read more than once. The heaviest
    HEAVY_KEYS groups (or ``heavy`` of them; a fixed number, so the broadcast is
    bounded) are joined where the rows lie, without a shuffle. No key that is left
    can hold more than one part in HEAVY_KEYS of the rows, so the shuffle join of
    the rest is even.
    """
    keys = list(keys)
    groups = materialize(groups, "groups")
    top = F.broadcast(groups.orderBy(F.col(size).desc(), *keys).limit(HEAVY_KEYS if heavy is None else heavy))
    hot = rows.join(top, keys, "inner")
    others = groups.join(top.select(*keys), keys, "left_anti")
    return hot.unionByName(rows.join(others, keys, "inner").select(*hot.columns))


def running_sums(df: DataFrame, order: str, coarse: Column, sums: Sequence[str], descending: bool = True) -> DataFrame:
    """Add ``<name>_before``: the sum over all rows strictly earlier in the order.

    ``coarse`` must be monotone in ``order``. Sums of whole coarse buckets run over
    the short bucket list; the rest runs inside each bucket, in parallel.
    """
    def direction(name: str) -> Column:
        return F.desc(name) if descending else F.asc(name)

    tagged = df.withColumn("_bucket", coarse)
    strictly_before = (Window.unboundedPreceding, -1)
    bucket_window = Window.orderBy(direction("_bucket")).rowsBetween(*strictly_before)
    totals = tagged.groupBy("_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select("_bucket", *[
        F.coalesce(F.sum(f"_t_{s}").over(bucket_window), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inner = Window.partitionBy("_bucket").orderBy(direction(order)).rowsBetween(*strictly_before)
    joined = tagged.join(offsets, "_bucket")
    return joined.select(*df.columns, *[
        (F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inner), F.lit(0))).alias(f"{s}_before") for s in sums])
