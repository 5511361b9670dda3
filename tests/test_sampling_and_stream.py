"""Sampling, logs, skewed joins, answers and the stream."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.operators import calibration as cal
from curatrix.operators import investigate as inv
from curatrix.operators import sampling as sp
from curatrix.operators import skew
from curatrix.streaming import scoring


def test_lookup_join_equals_plain_join_with_a_hot_key(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 5")
    want = {tuple(r) for r in rows.join(groups, "k").select("k", "id", "n").collect()}
    for heavy in (2, 1000):
        monkeypatch.setattr(skew, "HEAVY_KEYS", heavy)
        got = [tuple(r) for r in skew.lookup_join(rows, groups, ["k"], "n").select("k", "id", "n").collect()]
        assert len(got) == len(want) and set(got) == want


def test_weighted_sample_follows_the_weights(spark):
    df = spark.range(60).select(F.col("id").alias("item_id"), F.when(F.col("id") < 10, 5).when(F.col("id") == 59, 0).otherwise(1).alias("w"))
    drawn = sp.weighted_sample(df, "w", 20_000, seed=3, slot=16)
    rows = drawn.collect()
    assert len(rows) == 20_000 and len({r["draw"] for r in rows}) == 20_000
    counts = Counter(r["item_id"] for r in rows)
    assert 59 not in counts
    heavy = sum(counts[i] for i in range(10)) / 20_000
    assert abs(heavy - 50 / 99) < 0.02
    assert {tuple(r) for r in drawn.collect()} == {tuple(r) for r in rows}


def test_seeded_samples_repeat(spark):
    df = spark.range(200).withColumnRenamed("id", "item_id")
    a = [r[0] for r in sp.sample_n(df, 20, 1).collect()]
    assert a == [r[0] for r in sp.sample_n(df.repartition(7), 20, 1).collect()] and len(set(a)) == 20
    assert a != [r[0] for r in sp.sample_n(df, 20, 2).collect()]
    assert sp.oversample(df, 3).count() == 600


@pytest.mark.parametrize("alpha", [0.4, 1])
def test_mixup(spark, alpha):
    df = spark.range(40).select(F.col("id").alias("item_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"), (F.col("id") % 2).alias("y"))
    rows = sp.mixup(df, "x", "y", 10, alpha, 9).collect()
    assert sorted(r["partner_id"] for r in rows) == list(range(40))
    for r in rows:
        assert 0 <= r["lam"] <= 1
        assert abs(r["mixed"][0] - (r["lam"] * r["item_id"] + (1 - r["lam"]) * r["partner_id"])) < 1e-9
        assert r["label_a"] == r["item_id"] % 2 and r["label_b"] == r["partner_id"] % 2
    assert len({r["lam"] for r in rows}) == len({r["batch"] for r in rows})


def test_best_epoch_and_deltas(spark):
    scores = [0.5, 0.6, 0.55, 0.58, 0.59, 0.7]
    log = spark.createDataFrame(list(enumerate(scores, 1)), "epoch int, f1 double")
    rows = sp.best_epoch(log, "epoch", "f1", 3).orderBy("epoch").collect()
    assert [r["epochs_no_improve"] for r in rows] == [0, 0, 1, 2, 3, 0]
    assert [r["stops_here"] for r in rows] == [False, False, False, False, True, False]
    delta = sp.log_deltas(log, "epoch", ["f1"]).first()
    assert (delta["first"], delta["last"], delta["delta"]) == (0.5, 0.7, 0.2)


def test_tiers_and_bins_keep_everything(spark):
    p = [480_000, 519_999, 520_000, 649_999, 650_000, 800_000, 1_000_000]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(p)], "item_id long, label int, p_micro long")
    tiers = Counter(r["tier"] for r in sp.mine_hard_negatives(df, 0.48).collect())
    assert tiers == {"below": 2, "easy": 2, "medium": 1, "hard": 2}
    assert sum(r["n"] for r in inv.confidence_bins(df.where("p_micro >= 500000")).collect()) == 6


def test_metadata_flags(spark):
    df = spark.createDataFrame(
        [("Mail Tool", "m", "x", 1.0, 2.0, "2024-01-01 00:00:00"), ("Art AI", None, "x", None, 2.0, None),
         (None, "m", "x", 1.0, 2.0, "2024-01-01 11:59:30")],
        "software string, make string, model string, latitude double, longitude double, at string")
    meta = F.struct("software", "make", "model", "latitude", "longitude", F.to_timestamp("at").alias("captured_at"))
    rows = [r[0] for r in df.select(sc.metadata_flags(meta, F.lit("2024-01-01 12:00:00").cast("timestamp"))).collect()]
    assert rows == [["software tag: Mail Tool"],
                    ["ai software: Art AI", "no camera make/model", "gps data absent", "no original capture timestamp"],
                    ["created very recently"]]


def test_answers(spark):
    texts = ['<think>{"verdict":"no"}</think>```json\n{"verdict":"LIKELY DEEPFAKE","confidence":91,"signals":{"skin":{"score":3,"findings":["a"]}}}\n```',
             "no object", '{"verdict": broken']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(sc.parse_answer(F.col("t")).alias("a"), sc.answer_json(F.col("t")).alias("j")).collect()
    assert rows[0]["a"]["verdict"] == "LIKELY DEEPFAKE" and rows[0]["a"]["signals"]["skin"]["findings"] == ["a"]
    assert rows[1]["a"] is None and rows[1]["j"] is None and rows[2]["a"] is None


def test_external_model_loads_once_per_task(spark):
    df = spark.range(1000).select(F.col("id").alias("item_id"), (F.col("id") / 1000).alias("x")).coalesce(2)

    def load():
        loads = [0]

        def predict(batch):
            loads[0] += 1
            return batch["x"] * 0.5

        return predict

    rows = cal.score_external(df, load, ["x"]).collect()
    assert len(rows) == 1000 and all(abs(r["p"] - r["item_id"] / 2000) < 1e-12 for r in rows)


def test_stream_in_small_batches_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    source = str(tmp_path / "events")
    events.repartition(6).write.parquet(source)
    stream = scoring.read_events(spark, source, "*.parquet", files_per_trigger=2)
    query = scoring.score_stream(stream, str(tmp_path / "sink"), str(tmp_path / "state"))
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"] > 0]) == 3
    got = spark.read.parquet(str(tmp_path / "sink"))
    want = scoring.score_events(events)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
