"""Awkward rows and large numbers that the given tables do not hold."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.operators import calibration as cal
from curatrix.operators import labels as lb
from curatrix.operators import metrics as m
from curatrix.operators import neardup as nd
from curatrix.operators import profile as pr
from curatrix.operators import sampling as sp
from curatrix.sources import reports as rp
from curatrix.sources import tables as t
from curatrix.streaming import scoring


def test_short_texts_are_measured(spark, tmp_path):
    rows = [(0, "tiny", "src1"), (1, "", "src1"), (2, None, "src1"), (3, " \n ", "src2"), (4, "word " * 100, "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["item_id"]: r for r in t.item_metrics(spark, str(tmp_path)).collect()}
    assert [found[i]["is_corrupt"] for i in range(5)] == [False, True, True, True, False]
    assert found[0]["blur_score"] == 1.0 and found[0]["width"] == 4 and found[3]["width"] is None


def test_rates_leave_out_what_cannot_be_read(spark):
    flags = [f for f in pr.FLAG_COLUMNS if f != "is_corrupt"]
    rows = [(i, i >= 8, i < 2) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, is_corrupt boolean, flag boolean").select(
        "is_corrupt", *[(F.col("flag") & ~F.col("is_corrupt")).alias(f) for f in flags])
    rates = {r["flag"]: (r["n_flagged"], r["percent"]) for r in pr.flag_rates(df).collect()}
    assert rates["is_dark"] == (2, 25.0) and rates["is_corrupt"] == (2, 20.0)


def test_null_is_no_shared_hash(spark):
    rows = [(1, "Train", None), (2, "Test", None), (3, "Train", "a"), (4, "Test", "a")]
    df = spark.createDataFrame(rows, "item_id long, split string, content_md5 string")
    assert {(r["split_a"], r["split_b"]): r["n_shared"] for r in pr.shared_hash_matrix(df).collect()}[("Train", "Test")] == 1


def test_area_of_very_many_rows(spark):
    """Ten billion rows a class, as weights of a folded table."""
    folded = spark.createDataFrame([(1, 5 * 10 ** 9, 5 * 10 ** 9), (2, 5 * 10 ** 9, 5 * 10 ** 9)], "p long, pos long, neg long")
    class Folded:
        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return folded
    assert m.roc_auc(Folded()).first()["auc"] == 0.5


@pytest.mark.parametrize("n", [134_217_729, 699_999_999])
def test_pairs_of_many_copies(spark, n):
    assert spark.range(1).select(F.lit(n).cast("long").alias("n_a")).selectExpr("n_a * (n_a - 1) div 2 AS x").first()["x"] == n * (n - 1) // 2
    items = spark.createDataFrame([(i, "Train", "Real", 7) for i in range(5)], "item_id long, split string, class string, fp long")
    assert nd.near_dup_blocks(items, scope="same_split_class").first()["n_pairs"] == 10


def test_names_past_rank_999(spark):
    df = spark.range(1200).select(F.col("id").alias("item_id"), (F.col("id") * 100).alias("p_micro"))
    names = {r["rank"]: r["sample_name"] for r in rp.export_samples(df, 1200, "hn").collect()}
    assert len(set(names.values())) == 1200
    assert names[1].startswith("hn_000_p") and names[1001].startswith("hn_1000_p")


def test_a_list_that_holds_a_third_of_all_rows(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("class")).repartition(5)
    got = sp.cap_per_class(df, 5000).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("item_id").alias("last")).collect()
    by = {r["class"]: (r["n"], r["last"]) for r in got}
    assert by["hot"] == (5000, 3 * 4999) and sum(v[0] for v in by.values()) == 5000 + n - n // 3
    head = pr.head_per_list(df, ["class"], [F.col("item_id").desc()], 3).where("class = 'hot'").collect()
    assert sorted((r["place"], r["item_id"]) for r in head) == [(1, n - 3), (2, n - 6), (3, n - 9)]


def test_corrections_name_an_item_once(spark):
    items = spark.createDataFrame([(1, 0), (2, 1)], "item_id long, label int")
    flips = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (1, 1, 2)], "item_id long, corrected int, line int")
    assert sorted((r["item_id"], r["corrected"]) for r in lb.apply_corrections(items, flips).collect()) == [(1, 1), (2, 1)]
    assert lb.apply_corrections(items, flips.drop("line")).count() == 2


def test_medians_of_few_and_equal_values(spark):
    rng = np.random.default_rng(1)
    values = [float(x) for x in rng.integers(0, 40, 5001)]
    df = spark.createDataFrame([(v, None, 3.0) for v in values] + [(None, None, None)], "a double, b double, c double")
    assert {r["metric"]: r["median"] for r in pr.exact_medians(df, ["a", "b", "c"]).collect()} == {"a": float(np.median(values)), "c": 3.0}


@pytest.fixture(scope="module")
def featured(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), float(x), float(y), int(x + 0.3 * y + rng.normal() > 0)) for i, (x, y) in enumerate(rng.normal(size=(400, 2)))]
    return spark.createDataFrame([*rows, (1000, None, 1.0, 1), (1001, 0.5, None, 0)], "item_id long, x double, y double, label int")


def test_baseline_scores_every_row(featured):
    model = cal.fit_baseline(featured, ["x", "y"])
    rows = {r["item_id"]: r for r in cal.score(model, featured).collect()}
    assert len(rows) == 402 and rows[1000]["p"] is None and rows[1001]["p_micro"] is None
    right = sum((r["p"] > 0.5) == (r["label"] == 1) for r in rows.values() if r["p"] is not None)
    assert right > 300
    a, b = rows[0], rows[1]
    weight = np.linalg.lstsq(np.array([[r["x"], r["y"], 1] for r in rows.values() if r["p"] is not None]),
                             np.array([r["logit"] for r in rows.values() if r["p"] is not None]), rcond=None)[0]
    for r in (a, b):
        assert abs(weight @ [r["x"], r["y"], 1] - r["logit"]) < 1e-6


def test_stream_and_batch_agree(spark, featured, tmp_path):
    model = cal.fit_baseline(featured, ["x", "y"])
    featured.write.parquet(str(tmp_path / "in"))
    signals = {n: F.abs(F.col("x")) for n in ("high_freq_ratio", "low_var_ratio", "peak_ratio", "edge_ratio", "block_ratio", "symmetry_diff")}
    stream = spark.readStream.schema(featured.schema).parquet(str(tmp_path / "in"))
    scoring.stream_items(stream, model, signals, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = scoring.score_items(featured, model, signals)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect()))


def test_rounding_is_that_of_sql(spark):
    """0.1465 * 100 is 14.649999999999999: times ten it is 146.5, so SQL says 14.7, the shortest decimal 14.6."""
    import duckdb

    p = spark.range(10_001).select(F.col("id").alias("item_id"), (F.col("id") / 10_000).alias("p"))
    got = p.select("item_id", sc.calibrated_verdict(F.col("p"), 0.52).alias("v"), sc.rounded(1 - F.col("p") / 64, 6).alias("six")).select(
        "item_id", "v.confidence", "v.probability_fake", "v.risk_score", "six").orderBy("item_id").collect()
    want = duckdb.sql("""SELECT id, round(CASE WHEN p >= 0.52::DOUBLE THEN p ELSE 1::DOUBLE - p END * 100, 1), round(p * 100, 1), round(p * 100, 1), round(1 - p / 64, 6)
        FROM (SELECT range AS id, range::DOUBLE / 10000 AS p FROM range(10001)) ORDER BY id""").fetchall()
    assert [tuple(r) for r in got] == want and got[1465].probability_fake == 14.7
