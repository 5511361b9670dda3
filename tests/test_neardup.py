"""Blocked near-duplicate search against comparing everything with everything."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from curatrix.functions.bits import ALL_BITS, block_combos, block_masks, signed
from curatrix.operators import neardup as nd
from curatrix.operators.stems import min_distance_by_stem
from curatrix.plans import audit_queries
from curatrix.plans.registry import QUERIES
from curatrix.session import materialize

SPLITS, CLASSES = ("Train", "Validation", "Test"), ("Fake", "Real")


def planted(seed: int, n: int, shared_bits: int = 0) -> list[int]:
    """Random hashes, each with a copy some flips away; ``shared_bits`` high bits are the same in all."""
    rng = random.Random(seed)
    free = 64 - shared_bits
    prefix = rng.getrandbits(shared_bits) << free if shared_bits else 0
    out = []
    for _ in range(n):
        h = prefix | rng.getrandbits(free)
        out.append(h)
        for bit in rng.sample(range(free), rng.randint(0, 6)):
            h ^= 1 << bit
        out.append(h)
    return out


def distance(a: int, b: int) -> int:
    return ((a ^ b) & ALL_BITS).bit_count()


def brute(hashes: set[int], d: int) -> set[tuple[int, int, int]]:
    known = sorted(hashes)
    return {(a, b, distance(a, b)) for i, a in enumerate(known) for b in known[i + 1:] if distance(a, b) <= d}


def test_block_masks_cover_all_bits_once():
    for blocks in (6, 7, 8, 9, 10):
        masks = block_masks(blocks)
        assert sum(masks) == ALL_BITS and len(masks) == blocks
    assert len(block_combos(8, 5)) == 56


@pytest.mark.parametrize("blocks,d", [(8, 5), (7, 5), (9, 4), (6, 3)])
def test_pairs_equal_brute_force(spark, blocks, d):
    hashes = {signed(h) for h in planted(1, 250)}
    df = spark.createDataFrame([(h,) for h in hashes], "fp bigint")
    got = [tuple(r) for r in nd.fingerprint_pairs(df, d, blocks).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(hashes, d)


@pytest.mark.parametrize("hot", [3, 8, 40])
def test_crowded_buckets_lose_nothing(spark, hot):
    """Forty equal high bits crowd many buckets, so the second cut and the tiles do the work."""
    hashes = {signed(h) for h in planted(2, 120, shared_bits=40)} | {signed(h) for h in planted(3, 40)}
    df = spark.createDataFrame([(h,) for h in hashes], "fp bigint")
    got = [tuple(r) for r in nd.fingerprint_pairs(df, 5, 8, hot_bucket=hot).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(hashes, 5)


def make_items(spark, seed: int, n: int):
    rng = random.Random(seed)
    pool = [signed(h) for h in planted(seed, n // 4)]
    hot = pool[0]
    rows = []
    for i in range(n):
        fp = hot if i % 3 == 0 else rng.choice(pool)
        rows.append((i, rng.choice(SPLITS), rng.choice(CLASSES), f"m{fp}-{rng.randint(0, 1)}", fp))
    rows.append((n, "Test", "Fake", "none", None))
    return rows, spark.createDataFrame(rows, "item_id bigint, split string, class string, content_md5 string, fp bigint")


WANTED = {
    "cross_split": lambda a, b: a[1] != b[1],
    "cross_class": lambda a, b: a[2] != b[2],
    "same_split_class": lambda a, b: a[1:3] == b[1:3],
    "all": lambda a, b: True,
}


@pytest.mark.parametrize("scope", sorted(WANTED))
def test_blocks_count_every_pair_and_heads_are_exact(spark, scope):
    rows, items = make_items(spark, 4, 150)
    known = [r for r in rows if r[4] is not None]
    pairs = sorted(
        (distance(a[4], b[4]), a[0], b[0], a[1:3], b[1:3])
        for i, a in enumerate(known) for b in known[i + 1:]
        if distance(a[4], b[4]) <= 5 and WANTED[scope](a, b))
    blocks = nd.near_dup_blocks(items, scope=scope)
    counted = Counter()
    for r in blocks.collect():
        counted[r["distance"]] += r["n_pairs"]
    assert counted == Counter(p[0] for p in pairs)
    got = [(r["distance"], r["id_a"], r["id_b"], (r["split_a"], r["class_a"]), (r["split_b"], r["class_b"]))
           for r in nd.first_pairs(blocks, items, 25).collect()]
    assert got == pairs[:25]


def test_summary_adds_up(spark):
    rows, items = make_items(spark, 5, 120)
    summary = nd.near_dup_summary(nd.near_dup_blocks(items)).collect()
    assert sum(r["consistent"] + r["conflicting"] for r in summary) == sum(r["n_pairs"] for r in summary)


@pytest.mark.parametrize("tile", [2, 1000])
def test_min_distance_by_stem(spark, tile):
    rng = random.Random(6)
    rows = []
    for i in range(160):
        stem = i % 12
        fp = signed(rng.getrandbits(64)) if stem else signed(rng.choice((7, 11)))
        rows.append((i, SPLITS[rng.randint(0, 2)], fp, stem))
    rows += [(500, "Train", 0, 99), (501, "Train", 1, 99)]
    df = spark.createDataFrame(rows, "item_id bigint, split string, fp bigint, stem int")
    want = {}
    for stem in {r[3] for r in rows}:
        group = [r for r in rows if r[3] == stem]
        if len({r[1] for r in group}) > 1:
            want[stem] = (len(group), min(distance(a[2], b[2]) for i, a in enumerate(group) for b in group[i + 1:]))
    got = {r["stem"]: (r["n_items"], r["min_distance"]) for r in min_distance_by_stem(df, tile=tile).collect()}
    assert got == want


def broadcast_columns(df) -> list[str]:
    """Columns of what the physical plan sends through the driver, before anything has run."""
    plan = df._jdf.queryExecution().executedPlan()
    found, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "BroadcastExchangeExec":
            found.append(",".join(node.schema().fieldNames()))
        waiting += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_keys_and_cells_are_not_broadcast(spark):
    """56 keys for each fingerprint, and the cells, are many times what the optimizer takes them for."""
    rows = [(i, SPLITS[i % 3], CLASSES[i % 2], signed(h)) for i, h in enumerate(planted(5, 40))]
    items = spark.createDataFrame(rows, "item_id bigint, split string, class string, fp bigint")
    for df in (nd.near_dup_blocks(items, scope="all"), nd.fingerprint_pairs(items.select("fp").distinct())):
        assert not [c for c in broadcast_columns(df) if "fp" in c or "cells" in c]
        assert not [c for c in broadcast_columns(df) if "_tiles" in c]


#: Queries whose pairs go through ``near_dup_blocks``.
ON_BLOCKS = [
    "near_dups_cross_split",
    "duplicate_edges",
    "near_dups_cross_class",
    "near_dups_crowded",
    "near_dups_same_split_class",
    "pairs_conflicting",
    "pairs_consistent",
    "pairs_touching_test",
    "pairs_within_class",
]


@pytest.mark.parametrize("name", ON_BLOCKS)
def test_queries_on_blocks_broadcast_no_keys_or_cells(spark, data, monkeypatch, name):
    """What a query writes on its way counts like what it returns."""
    plans = []

    def noted(df, label):
        plans.append(df)
        return materialize(df, label)

    monkeypatch.setattr(nd, "materialize", noted)
    monkeypatch.setattr(audit_queries, "materialize", noted)
    plans.append(QUERIES[name](spark, data))
    sent = [columns.split(",") for df in plans for columns in broadcast_columns(df)]
    assert not [c for c in sent if "value" in c and any(x.startswith("fp") for x in c) or any(x.startswith("cells") for x in c)]
