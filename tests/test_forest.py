"""Spanning forests of near fingerprints: the same components as all pairs, at a bounded number of rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from curatrix.functions.bits import signed
from curatrix.operators import components as comp
from curatrix.operators import forest as fo
from curatrix.operators import neardup as nd


def labels(edges, nodes):
    """Smallest node reachable, by flooding."""
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        todo = [start] if start not in out else []
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += near[n]
    return out


def cloud(draw, size, flips, spread=64):
    """Different hashes, each a few flips from a centre."""
    centre, out = draw.getrandbits(64), set()
    while len(out) < size:
        out.add(centre ^ sum(1 << b for b in draw.sample(range(spread), draw.randint(0, flips))))
    return sorted(out)


def pairs(rows, distance):
    """rows: (fp, groups); pairs in one and the same single group do not count."""
    return [(a, b) for i, (a, g) in enumerate(rows) for b, h in rows[:i]
            if (a ^ b).bit_count() <= distance and (g != h or g.bit_count() > 1)]


@pytest.mark.parametrize("hot", [20_000, 30])
def test_forest_connects_what_pairs_connect(spark, hot):
    draw = random.Random(1)
    fps = sorted({*cloud(draw, 120, 3), *cloud(draw, 60, 6), *[draw.getrandbits(64) for _ in range(100)]})
    chain = draw.getrandbits(64)
    for i in range(40):  # each five flips from the one before
        chain ^= sum(1 << b for b in draw.sample(range(64), 5))
        fps.append(chain)
    rows = [(f, draw.choice([1, 1, 1, 2, 4, 3])) for f in dict.fromkeys(fps)]
    df = spark.createDataFrame([(signed(f), g) for f, g in rows], "fp long, groups int")
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in fo.near_forest(df, hot_bucket=hot).collect()]
    want = pairs(rows, 5)
    assert {tuple(sorted(e)) for e in got} <= {tuple(sorted(e)) for e in want} and len(got) < len(want)
    nodes = [f for f, _ in rows]
    assert labels(got, nodes) == labels(want, nodes)


def test_one_dense_cloud(spark):
    """20,000 different hashes around one: 2 * 10^8 pairs are near or nearly, the edges stay below 56 for each hash."""
    draw = random.Random(2)
    fps = cloud(draw, 20_000, 3, spread=60)
    df = spark.createDataFrame([(signed(f), 1 << i % 3) for i, f in enumerate(fps)], "fp long, groups int").repartition(8)
    edges = fo.near_forest(df)
    rows = np.array([(r.a, r.b) for r in edges.collect()])
    assert 19_999 <= len(rows) <= 56 * 20_000
    assert comp.connected_components(edges).select("component").distinct().count() == 1


def test_components_with_and_without_pairs(spark):
    draw = random.Random(3)
    hashes = [signed(f) for f in cloud(draw, 60, 4) + cloud(draw, 30, 7) + [draw.getrandbits(64) for _ in range(40)]]
    rows = []
    for i in range(400):
        split = draw.choice(["Train"] * 5 + ["Validation", "Test", "Other"])
        rows.append((i, split, draw.choice(["Fake", "Real"]), f"md5-{draw.randint(0, 4000)}", draw.choice(hashes + [None])))
    items = spark.createDataFrame(rows, "item_id long, split string, class string, content_md5 string, fp long")
    known = items.where("split <> 'Other'")
    for table in (known, items):
        got = sorted(map(tuple, comp.duplicate_components(table).collect()))
        assert got == sorted(map(tuple, comp.duplicate_components(table, nd.near_dup_blocks(table)).collect()))
    assert len({r[3] for r in got}) > 1


def test_empty(spark):
    items = spark.createDataFrame([], "item_id long, split string, class string, content_md5 string, fp long")
    assert comp.duplicate_components(items).collect() == []


def test_only_buckets_with_near_pairs_are_opened():
    """Many buckets at once against each by itself; large ones are always opened."""
    draw = np.random.default_rng(4)
    sizes = np.concatenate([draw.integers(1, 9, 400), [fo.SMALL, fo.SMALL + 1, 1]])
    fps = draw.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    for at in draw.choice(len(fps) - 3, 120, replace=False):
        fps[at + draw.integers(1, 4)] = fps[at] ^ np.uint64(1 << int(draw.integers(0, 63)))
    groups = draw.integers(1, 4, len(fps))
    ends = np.cumsum(sizes)
    want = [k for k, (s, e) in enumerate(zip(ends - sizes, ends)) if e - s > fo.SMALL or any(
        (int(fps[i]) ^ int(fps[j])).bit_count() <= 5 and not groups[i] == groups[j] in (1, 2) for i in range(s, e) for j in range(s, i))]
    assert fo.worth_opening(fps, groups, sizes, 5).tolist() == want and 20 < len(want) < 200
