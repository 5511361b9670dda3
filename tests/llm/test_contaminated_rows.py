"""Contaminated rows go by id and text, also where ids are null or shared."""

from __future__ import annotations

from curatrix.llm import decontaminate


def test_null_and_shared_ids(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, f"a {passage} b"), (None, "clean text without an id"), (7, passage), (7, "clean text that shares its id"), (8, None), (9, ""), (None, None), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = sorted(((r.doc_id, r.text) for r in decontaminate.drop_contaminated(docs, items).collect()), key=str)
    assert out == sorted((r for r in rows if passage not in (r[1] or "")), key=str)
