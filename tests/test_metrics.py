"""Metrics against the published rows, brute force and a fine search."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import calibration as cal
from curatrix.operators import labels as lb
from curatrix.operators import metrics as m
from curatrix.operators import profile as pr

# Published counts (tp, fp, tn, fn) and the rates published with them.
PUBLISHED_ROWS = [
    ((4443, 2696, 2717, 1049), (0.65658, 0.62236, 0.80899, 0.70351, 0.49806, 0.19101)),
    ((2310, 656, 4757, 3182), (0.64805, 0.77883, 0.42061, 0.54623, 0.12119, 0.57939)),
    ((2270, 624, 4789, 3222), (0.64732, 0.78438, 0.41333, 0.54138, 0.11528, 0.58667)),
]


def test_rates_reproduce_published_numbers(spark):
    df = spark.createDataFrame([c for c, _ in PUBLISHED_ROWS], "tp long, fp long, tn long, fn long")
    for row, (cells, want) in zip(sorted(m.rates(df, 5).collect(), key=lambda r: -r["tp"]), PUBLISHED_ROWS):
        assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["fpr"], row["fnr"]) == want


def test_empty_denominators_give_zero(spark):
    row = m.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()
    assert all(row[c] == 0 for c in ("accuracy", "precision", "recall", "f1", "fpr", "fnr"))


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    rows = []
    for i in range(900):
        label = int(rng.random() < 0.4)
        p = min(max(rng.gauss(0.6 if label else 0.4, 0.2), 0.0), 1.0)
        p_micro = round(p, 2) * 1_000_000 if i % 3 == 0 else p * 1_000_000
        p_micro = round(p_micro)
        q = min(max(p_micro / 1e6, 1e-6), 1 - 1e-6)
        rows.append((i, label, p_micro, math.log(q / (1 - q))))
    df = spark.createDataFrame(rows, "item_id long, label int, p_micro long, logit double")
    return rows, df


@pytest.mark.parametrize("grid", [m.PUBLISHED, m.COARSE, m.ROC_GRID, m.PR_GRID])
def test_sweep_equals_one_confusion_per_threshold(scored, grid):
    rows, df = scored
    sweep = sorted(m.threshold_sweep(df, grid).collect(), key=lambda r: r["k"])
    assert len(sweep) == grid.size
    for r in sweep:
        k = r["k"]
        def called(p):
            return p * grid.scale >= (grid.start + grid.step * k) * 1_000_000
        assert r["tp"] == sum(1 for x in rows if x[1] == 1 and called(x[2]))
        assert r["fp"] == sum(1 for x in rows if x[1] == 0 and called(x[2]))
        assert r["tp"] + r["fn"] == sum(x[1] for x in rows) and r["tp"] + r["fp"] + r["tn"] + r["fn"] == len(rows)
    assert all(a["tp"] >= b["tp"] and a["fp"] >= b["fp"] for a, b in zip(sweep, sweep[1:]))


def test_best_threshold_takes_the_lowest_on_ties(spark):
    df = spark.createDataFrame([(1, 900_000), (0, 100_000)], "label int, p_micro long")
    assert m.choose_threshold(m.threshold_sweep(df)) == 0.30
    nothing = spark.createDataFrame([(0, 950_000), (1, 10_000)], "label int, p_micro long")
    assert m.choose_threshold(m.threshold_sweep(nothing), 0.05) == 0.5


def test_auc_counts_pairs(spark, scored):
    rows, df = scored
    pos, neg = [x[2] for x in rows if x[1] == 1], [x[2] for x in rows if x[1] == 0]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert m.roc_auc(df).first()["auc"] == round(want, 6)
    assert m.roc_auc(df.where("label = 1")).first()["auc"] == 0.5


def test_temperature_matches_a_fine_search(scored):
    rows, df = scored

    def loss(t):
        return sum(max(z / t, 0) - z / t * y + math.log1p(math.exp(-abs(z / t))) for _, y, _, z in rows)

    lo, hi = 0.05, 20.0
    for _ in range(200):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    assert abs(cal.fit_temperature(df) - lo) < 1e-5


def test_platt_is_stationary(scored):
    rows, df = scored
    w, b = cal.fit_platt(df)
    errors = [(1 / (1 + math.exp(-(w * z + b))) - y, z) for _, y, _, z in rows]
    assert abs(sum(e for e, _ in errors)) < 1e-3 and abs(sum(e * z for e, z in errors)) < 1e-2


def test_isotonic_is_monotone(scored):
    _, df = scored
    rows = cal.apply_isotonic(cal.fit_isotonic(df), df).orderBy("p_micro").select("p_iso").collect()
    values = [r[0] for r in rows]
    assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0, 9.0], [float(i % 97) for i in range(3001)], [i * 0.37 for i in range(5000)]])
def test_median_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    ordered = sorted(values)
    want = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    assert pr.exact_medians(df, ["x"]).first()["median"] == want
    row = pr.profile(df, ["x"]).first()
    assert row["median"] == round(want, 6) and row["n"] == len(values)


def test_profile_of_nothing(spark):
    row = pr.profile(spark.createDataFrame([(None,)], "x double"), ["x"]).first()
    assert row["n"] == 0 and row["median"] is None


def test_histogram_last_bin_is_closed_and_bins_complete(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "x double")
    assert [r["n"] for r in pr.histogram(df, "x", 4, 0.0, 1.0).orderBy("bin").collect()] == [1, 0, 1, 2]


def test_mislabel_strongest_first_and_corrections(spark):
    df = spark.createDataFrame([(1, 1, 50_000), (2, 0, 990_000), (3, 1, 500_000), (4, 1, 10_000)], "item_id long, label int, p_micro long")
    found = lb.mislabel_candidates(df).orderBy(F.desc("disagreement"), "item_id").collect()
    assert [r["item_id"] for r in found] == [2, 4, 1] or [r["item_id"] for r in found] == [4, 2, 1]
    flips = spark.createDataFrame([(4, 0)], "item_id long, corrected int")
    assert {r["item_id"]: r["corrected"] for r in lb.apply_corrections(df, flips).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


def test_overlap_bounds(spark):
    same = spark.createDataFrame([(y, p) for y in (0, 1) for p in (100_000, 900_000)], "label int, p_micro long")
    apart = spark.createDataFrame([(0, 100_000), (1, 900_000)], "label int, p_micro long")
    assert lb.class_overlap(same).first()["overlap"] == 1.0 and lb.class_overlap(apart).first()["overlap"] == 0.0
