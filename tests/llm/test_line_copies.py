"""Copies of a page are one page for the line stage of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from curatrix.llm import line_dedup


def rows():
    """A host with a third of its rows being one document, and a line that a quarter of its other pages have."""
    copied = "\n".join(f"line {k} of the copied document" for k in range(6))
    out = [(i, copied) for i in range(20)]
    out += [(100 + i, f"page {i} of its own" + ("\nhome | about | contact" if i % 4 == 0 else "")) for i in range(40)]
    return [(d, t, "en", "host", len(t)) for d, t in out] + [(500, None, "en", "host", None), (501, "x", "en", None, 1)], copied


def test_copied_document_keeps_its_lines(spark):
    given, copied = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert all(out[i] == copied for i in range(20))
    assert all(out[100 + i] == f"page {i} of its own" for i in range(40)) and out[500] is None and out[501] == "x"
    left = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.lines(spark, docs, ""), "").collect()}
    assert left[0] == copied and not set(range(1, 20)) & left.keys()


def test_totals_count_distinct_pages(spark):
    """5 of 41 distinct pages have the line; with copies in the total it would stay."""
    given = [(i, "copied", "h") for i in range(60)] + [(100 + i, f"own {i}" + ("\nmenu" if i < 5 else ""), "h") for i in range(40)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string")
    assert line_dedup.drop_boilerplate(docs, copies_count=False).where("n_dropped > 0").count() == 5
