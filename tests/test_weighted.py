"""Weighted draws against a line laid by hand."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from itertools import accumulate

import pytest

from curatrix.operators import sampling as sp


def by_hand(weights, draws, seed):
    order = sorted((k for k, w in weights.items() if w and w > 0), key=lambda k: (hashlib.md5(str(k).encode()).hexdigest()[:3], k))
    ends = list(accumulate(weights[k] for k in order))
    digits = 12 if ends[-1] <= 2 ** 38 else 15
    numbers = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:digits], 16) % ends[-1] for i in range(draws))
    return {i: order[bisect_right(ends, u)] for i, u in enumerate(numbers)}


@pytest.mark.parametrize("slot", [40, 1_000_000])
@pytest.mark.parametrize("heavy", [1, 300, 10 ** 9])
def test_one_item_with_a_third_of_the_weight(spark, slot, heavy):
    weights = {k: heavy * (1 + k % 3) for k in range(300)} | {300: 300 * heavy, 301: 0, 302: None, 303: -5}
    df = spark.createDataFrame([(k, w, f"t{k}") for k, w in weights.items()], "item_id long, w long, t string").repartition(3)
    rows = sp.weighted_sample(df, "w", 2000, 4, slot=slot).collect()
    assert {r.draw: r.item_id for r in rows} == by_hand(weights, 2000, 4) and len(rows) == 2000
    assert all(r.t == f"t{r.item_id}" and r.w == weights[r.item_id] for r in rows)


def test_rows_per_range(spark, monkeypatch):
    """An item with nearly all the weight: no range of items and draws is much over its size."""
    written = []
    real = sp.materialize
    monkeypatch.setattr(sp, "materialize", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    df = spark.range(2000).selectExpr("id as item_id", "case when id = 7 then 1000000000 else 1 end as w")
    assert sp.weighted_sample(df, "w", 10_000, 1, slot=500).where("item_id = 7").count() > 9_900
    line = next(f for name, f in written if name == "weighted-line")
    assert line.count() == 12_000 and max(r["count"] for r in line.groupBy("_part").count().collect()) < 2_000


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "item_id long, w long")
    assert sp.weighted_sample(none, "w", 5, 1).collect() == []
    zero = spark.createDataFrame([(1, 0)], "item_id long, w long")
    assert sp.weighted_sample(zero, "w", None, 1).columns == ["draw", "item_id", "w"]
    with pytest.raises(ValueError):
        sp.weighted_sample(spark.createDataFrame([(1, 2 ** 60)], "item_id long, w long"), "w", 1, 1)
