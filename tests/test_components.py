"""Components, keepers and quarantine against a plain flood over item pairs."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from curatrix.operators import components as comp
from curatrix.operators import neardup as nd
from curatrix.plans.cleaning import find_leakage
from tests.test_neardup import distance, make_items

ORDER = {"Test": 0, "Validation": 1, "Train": 2}


def flooded(edges):
    """Breadth-first flood from the smallest node that is still dry."""
    beside = defaultdict(set)
    for a, b in edges:
        beside[a].add(b)
        beside[b].add(a)
    label = {}
    for source in sorted(beside):
        wave = [source] if source not in label else []
        while wave:
            label.update(dict.fromkeys(wave, source))
            wave = [n for n in set().union(*(beside[w] for w in wave)) if n not in label]
    return label


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_connected_components(spark, shape):
    rng = random.Random(7)
    edges = {
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)],
        "path": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 300)] + [(1000, 1001)],
    }[shape]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in comp.connected_components(df).collect()}
    assert got == flooded(edges)


def test_no_edges(spark):
    assert comp.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def item_edges(rows):
    edges = []
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            if a[4] is not None and b[4] is not None and a[1] != b[1] and distance(a[4], b[4]) <= 5:
                edges.append((a[0], b[0]))
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    for members in groups.values():
        if len({r[1] for r in members}) > 1:
            edges += [(a[0], b[0]) for a, b in zip(members, members[1:])]
    return edges


@pytest.mark.parametrize("gaps", [False, True])
def test_duplicate_components_and_quarantine(spark, gaps):
    rows, _ = make_items(spark, 8, 140)
    if gaps:  # copies without a fingerprint, and one content with two fingerprints
        rows += [(900, "Train", "Fake", "x", None), (901, "Test", "Real", "x", None), (902, "Train", "Fake", rows[1][3], None),
                 (903, "Validation", "Real", rows[1][3], rows[1][4] ^ 0x5555)]
    schema = "item_id bigint, split string, class string, content_md5 string, fp bigint"
    result = find_leakage(spark.createDataFrame(rows, schema))
    want = flooded(item_edges(rows))
    assert {r["item_id"]: r["component"] for r in result.members.collect()} == want

    split = {r[0]: r[1] for r in rows}
    groups = defaultdict(list)
    for item, root in want.items():
        groups[root].append(item)
    kept = {root: min(g, key=lambda i: (ORDER[split[i]], i)) for root, g in groups.items()}
    removed = {(r["item_id"], r["kept_id"]) for r in result.removed.collect()}
    assert removed == {(i, kept[root]) for i, root in want.items() if i != kept[root]}

    out = {i for i, _ in removed}
    left = [r for r in rows if r[0] not in out]
    assert not item_edges(left), "survivors still share content across splits"
    report = result.report().collect()
    assert sum(r["removed"] for r in report) == len(out) and sum(r["total"] for r in report) == len(rows)
    summary = result.summary().first()
    assert summary["files_quarantined"] == len(out)
    assert summary["edges_used"] == len(item_edges(rows))
    assert summary["components_spanning_splits"] == len(groups)


def test_keep_best_split(spark):
    _, items = make_items(spark, 9, 100)
    members = comp.duplicate_components(items, nd.near_dup_blocks(items))
    rows = members.collect()
    best = defaultdict(lambda: 9)
    for r in rows:
        best[r["component"]] = min(best[r["component"]], ORDER[r["split"]])
    got = {r["item_id"] for r in comp.quarantine(members, keep="best_split").collect()}
    assert got == {r["item_id"] for r in rows if ORDER[r["split"]] > best[r["component"]]}
