"""Merged block stacks against the definition: the largest of the lowest means of all spans."""

from __future__ import annotations

import random

import pytest

from curatrix.operators import isotonic as iso


def by_hand(rows):
    points = {}
    for z, y, w in rows:
        n, s = points.get(z, (0, 0))
        points[z] = (n + w, s + w * y)
    zs = sorted(points)
    ws, ys = [points[z][0] for z in zs], [points[z][1] for z in zs]
    out = {}
    for i, z in enumerate(zs):
        out[z] = max(min(sum(ys[j:k + 1]) / sum(ws[j:k + 1]) for k in range(i, len(zs))) for j in range(i + 1))
    return out


def at(want, x):
    zs = sorted(want)
    if x <= zs[0] or x >= zs[-1]:
        return want[zs[0]] if x <= zs[0] else want[zs[-1]]
    b = next(i for i in range(len(zs)) if zs[i] > x)
    a, c = zs[b - 1], zs[b]
    return want[a] + (x - a) / (c - a) * (want[c] - want[a])


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "labels"])
def test_against_the_definition(spark, shape):
    rng = random.Random(shape)
    make = {"noise": lambda z: z / 2 + rng.gauss(0, 1), "rising": lambda z: z, "falling": lambda z: -z, "labels": lambda z: float(rng.random() < z / 8)}[shape]
    rows = [(z, make(z), rng.choice([1.0, 2.0, 0.5])) for z in (rng.choice([rng.gauss(3, 2), rng.randrange(8)]) + 0.0 for _ in range(90))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0), (float("nan"), 0.0, 1.0), (1.0, None, 1.0), (1.5, 9.0, 0.0)], "z double, y double, w double").repartition(5)
    want = by_hand(rows)
    blocks = iso.fit(df, "z", "y", "w", task_rows=7).cache()
    found = sorted(blocks.collect())
    assert all(a.p < b.p and a.hi < b.lo and a.next_lo == b.lo and a.next_p == b.p for a, b in zip(found, found[1:]))
    for z, p in want.items():
        assert [b.p for b in found if b.lo <= z <= b.hi] == [pytest.approx(p)]
    asked = [*want, -50.0, 50.0, *(rng.uniform(-2, 9) for _ in range(40))]
    points = spark.createDataFrame([(i, x) for i, x in enumerate([*asked, None, float("nan"), asked[0]])], "id int, s double")
    got = {r.id: r.p_iso for r in iso.apply(blocks, points, "s", task_rows=9).collect()}
    assert len(got) == len(asked) + 3 and got[len(asked)] is None and got[len(asked) + 1] is None and got[len(asked) + 2] == got[0]
    for i, x in enumerate(asked):
        assert got[i] == pytest.approx(at(want, x))


def test_nothing_to_fit(spark):
    none = spark.createDataFrame([], "z double, y int")
    blocks = iso.fit(none, "z", "y")
    assert blocks.isEmpty()
    row = iso.apply(blocks, spark.createDataFrame([(0.5,)], "z double"), "z").first()
    assert row.z == 0.5 and row.p_iso is None
    assert iso.apply(blocks, none, "z").isEmpty()


def test_one_score_with_most_rows(spark):
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 0.5 else id / 3000 end as z", "cast(id % 2 as int) as y")
    blocks = iso.fit(df, "z", "y", task_rows=100)
    assert blocks.selectExpr("sum(n)").first()[0] == 3000
    assert iso.apply(blocks, df, "z", task_rows=100).where("p_iso is null").isEmpty()
