"""Smallest distances by stem, where one stem holds a third of all fingerprints and nothing in it is near."""

from __future__ import annotations

import random

import numpy as np

from curatrix.functions.bits import signed
from curatrix.operators import stems
from curatrix.session import materialize


def spread(draw, size, apart):
    """Different hashes that are at least ``apart`` bits from each other."""
    out = np.empty(0, np.uint64)
    while len(out) < size:
        f = np.uint64(draw.getrandbits(64))
        if not len(out) or np.bitwise_count(out ^ f).min() >= apart:
            out = np.append(out, f)
    return out.tolist()


def test_large_stems_leave_step_by_step(spark, monkeypatch):
    draw, rows = random.Random(6), []
    base = {name: spread(draw, 300, 17) for name in "abcd"}
    for name, near in (("a", 6), ("b", 9), ("c", 11), ("d", None)):
        fps = base[name] + ([base[name][0] ^ sum(1 << b for b in draw.sample(range(64), near))] if near else [])
        rows += [(f, name) for f in fps]
    rows += [(f, f"s{i % 40}") for i, f in enumerate(spread(draw, 120, 14))]
    table = [(i, ("Train", "Test")[i % 2], name, signed(f)) for i, (f, name) in enumerate(rows)]
    items = spark.createDataFrame(table, "item_id long, split string, stem string, fp long")

    steps = []
    real = stems.nearest_by_quarters
    monkeypatch.setattr(stems, "nearest_by_quarters", lambda fps, stem, flips: steps.append(
        (flips, {r[0] for r in fps.select(stem).distinct().collect()})) or real(fps, stem, flips))
    got = {r.stem: r.min_distance for r in stems.min_distance_by_stem(items, few=100).collect()}
    by_stem = {}
    for _, _, name, f in table:
        by_stem.setdefault(name, []).append(np.uint64(f & (1 << 64) - 1))
    want = {n: min(int((a ^ b).bit_count()) for i, a in enumerate(map(int, fs)) for b in map(int, fs[:i])) for n, fs in by_stem.items()}
    assert got == {n: want[n] for n in got} and {"a", "b", "c", "d"} <= set(got) and want["a"] == 6 and want["c"] == 11
    # Only large stems are looked up by quarters, and each leaves at its first hit.
    assert steps == [(1, {"a", "b", "c", "d"}), (2, {"b", "c", "d"})]


def test_flipped_keys_are_not_broadcast(spark):
    # Read from files: only those are small in the eyes of the optimizer.
    items = materialize(spark.createDataFrame([("s", signed(f)) for f in spread(random.Random(8), 20, 9)], "stem string, fp long"), "flipped")
    plan = stems.nearest_by_quarters(items, "stem", 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
