"""Reports and answers of unknown shape."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from curatrix.sources import loose


@pytest.fixture
def folder(tmp_path):
    made = {
        "a.json": json.dumps({"total": 3, "near": {"pairs": [{"d": 4}, {"d": 1.5}]}, "new key.x": None}),
        "b.json": '{"total": "many", "corrupt": ["p1", "p2"]}\n',
        "c.json": '{"total": 3, "near": {',
        "d.json": "[1, true]",
        "e.json": "  \n ",
        "f.json": "null",
        "g.json": json.dumps({"total": 10 ** 30, "text": "ä" * 100_000}),
    }
    for name, text in made.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_unknown_keys_and_damage(spark, folder):
    reports = loose.read_loose(spark, folder)
    got = {r.file: (r.damaged, r.total, r.d, r.first) for r in reports.select(
        "file", "damaged", loose.loose_value("report", "$.total", "bigint").alias("total"),
        loose.loose_value("report", "$.near.pairs[1].d", "double").alias("d"), loose.loose_value("report", "$[0]", "int").alias("first")).collect()}
    assert got == {"a.json": (None, 3, 1.5, None), "b.json": (None, None, None, None), "c.json": ('{"total": 3, "near": {', None, None, None),
                   "d.json": (None, None, None, 1), "f.json": (None, None, None, None), "g.json": (None, None, None, None)}


def test_entries(spark, folder):
    rows = loose.loose_entries(loose.read_loose(spark, folder)).select("file", "key", F.to_json("value").alias("v"), "type").collect()
    assert sorted(((r.file, r.key or "", r.v if len(r.v) < 99 else len(r.v), r.type) for r in rows), key=str) == sorted([
        ("a.json", "total", "3", "BIGINT"), ("a.json", "near", '{"pairs":[{"d":4},{"d":1.5}]}', "OBJECT<pairs: ARRAY<OBJECT<d: DECIMAL(21,1)>>>"),
        ("a.json", "new key.x", "null", "VOID"), ("b.json", "total", '"many"', "STRING"), ("b.json", "corrupt", '["p1","p2"]', "ARRAY<STRING>"),
        ("d.json", "", "1", "BIGINT"), ("d.json", "", "true", "BOOLEAN"), ("g.json", "total", "1" + "0" * 30, "DECIMAL(31,0)"),
        ("g.json", "text", 100_002, "STRING")], key=str)


def test_schema(spark, folder):
    reports = loose.read_loose(spark, folder)
    assert loose.loose_schema(reports.where("file = 'a.json'")) == "OBJECT<near: OBJECT<pairs: ARRAY<OBJECT<d: DECIMAL(21,1)>>>, `new key.x`: VOID, total: BIGINT>"
    assert loose.loose_schema(reports.where("file in ('a.json', 'd.json')")) == "VARIANT"
    assert loose.loose_schema(reports.where("file = 'c.json'")) == "VOID"


def test_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n{"b": [2]}\n')
    rows = loose.read_loose(spark, str(tmp_path), one_document=False)
    assert rows.count() == 3 and rows.where("damaged is not null").count() == 1


def test_answers(spark):
    texts = ['<think>{"no": 1}</think> Sure: ```json\n{"verdict": "FAKE", "extra": {"z": [1]}}\n```', "no object", "{broken", None, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    answer = loose.parse_loose_answer(F.col("t"))
    got = [tuple(r) for r in df.select("i", loose.loose_value(answer, "$.verdict", "string"), loose.loose_value(answer, "$.extra.z[0]", "int"), answer.isNull()).orderBy("i").collect()]
    assert got == [(0, "FAKE", 1, False), (1, None, None, True), (2, None, None, True), (3, None, None, True), (4, None, None, False)]
