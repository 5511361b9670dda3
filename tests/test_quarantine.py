"""Versions of a quarantine: publish, restore, failed and competing writes, retried log records."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from curatrix.sources import quarantine as qu

SCHEMA = "item_id long, split string, class string, note string"


def table(spark, ids):
    return spark.createDataFrame([(i, ("Train", "Test", None)[i % 3], ("1", "Real")[i % 2], None) for i in ids], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_publish_and_restore(spark, tmp_path):
    path = f"{tmp_path}/q"
    assert qu.latest(spark, path) == 0 and qu.versions(spark, path).isEmpty()
    first, second = table(spark, range(10)), table(spark, range(5, 20))
    assert qu.quarantine(first, path) == 1 and qu.quarantine(second, path, "more") == 2
    assert rows(qu.read_quarantine(spark, path)) == rows(second)
    assert qu.restore(spark, path, 1) == 3
    now = qu.read_quarantine(spark, path)
    assert now.columns == first.columns and rows(now) == rows(first) and rows(qu.read_quarantine(spark, path, 2)) == rows(second)
    assert rows(qu.changes(spark, path, 2, 3)) == sorted([(i, "entered") for i in range(5)] + [(i, "left") for i in range(10, 20)], key=str)
    assert qu.quarantine(first.limit(0), path) == 4 and rows(qu.read_quarantine(spark, path)) == []
    assert sorted((r.version, r.n_items, r.note) for r in qu.versions(spark, path).collect()) == [
        (1, 10, ""), (2, 15, "more"), (3, 10, "restored 1"), (4, 0, "")]
    with pytest.raises(ValueError):
        qu.restore(spark, path, 9)


def test_failed_and_competing_writes(spark, tmp_path, monkeypatch):
    path, good = f"{tmp_path}/q", table(spark, range(6))
    qu.quarantine(good, path)
    broken = table(spark, range(50)).withColumn("note", F.when(F.col("item_id") == 40, F.raise_error(F.lit("lost"))))
    with pytest.raises(PySparkException):
        qu.quarantine(broken, path)
    assert qu.latest(spark, path) == 1 and rows(qu.read_quarantine(spark, path)) == rows(good)
    monkeypatch.setattr(qu, "latest", lambda *_: 0)  # a writer that has not seen version 1
    with pytest.raises(FileExistsError):
        qu.quarantine(table(spark, range(9)), path)
    monkeypatch.undo()
    assert rows(qu.read_quarantine(spark, path)) == rows(good)


def test_retried_record(spark, tmp_path):
    path = f"{tmp_path}/log"
    for key, n in (("0001", 5), ("0002", 7), ("0002", 7)):
        qu.append_record(spark.createDataFrame([(key, n)], "run string, mined int"), path, key)
    assert sorted((r.run, r.mined) for r in qu.read_records(spark, path).collect()) == [("0001", 5), ("0002", 7)]
