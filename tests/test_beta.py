"""Seeded beta draws: moments, repeatability, bounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from curatrix.operators import sampling as sp


@pytest.mark.parametrize("alpha", [0.05, 0.4, 0.5, 0.7, 1.5, 30])
def test_moments(spark, alpha):
    keys = spark.range(20_000)
    x = keys.select(sp.beta_draw(F.col("id"), alpha, 3).alias("x"))
    row = x.selectExpr("avg(x) m", "var_samp(x) v", "min(x) lo", "max(x) hi", "count(x) n", "kurtosis(x) k").first()
    variance = 1 / (4 * (2 * alpha + 1))
    assert row.n == 20_000 and 0 <= row.lo and row.hi <= 1
    assert abs(row.m - 0.5) < 4 * (variance / 20_000) ** 0.5
    assert row.v == pytest.approx(variance, rel=0.05)
    assert row.k == pytest.approx(-6 / (2 * alpha + 3), abs=0.12)


def test_repeats_and_nulls(spark):
    keys = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for alpha in (0.4, 2):
        def draw(seed):
            return {r.k: r.x for r in keys.repartition(2).select("k", sp.beta_draw(F.col("k"), alpha, seed).alias("x")).collect()}
        assert draw(1) == draw(1) and draw(1)[None] is None
        assert draw(1)[1] != draw(2)[1] and draw(1)[1] != draw(1)[2]
    with pytest.raises(ValueError):
        sp.beta_draw(F.col("k"), 0, 1)
