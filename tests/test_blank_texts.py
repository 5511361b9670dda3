"""Texts without a token: they have no score, and queries over scores take them as they are."""

from __future__ import annotations

import pytest

from curatrix.plans.registry import QUERIES
from curatrix.sources import tables as t
import curatrix.plans.training_queries  # noqa: F401

TEXTS = ["one two two 3!", "Some WORDS, of a longer text here.\nAnd more, and more of it 1234.", "x", "a a a a 99 99 a a"] * 6
BLANK = ["", " ", "\n\t ", None]


def folder(spark, path, blanks_labelled):
    rows = [(i, text, "en", f"src{i % 3}", len(text or "")) for i, text in enumerate(TEXTS + BLANK)]
    labels = [(i, i % 2, i % 3 // 2) for i in range(len(TEXTS) + (len(BLANK) if blanks_labelled else 0))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("blanks_labelled", [False, True])
def test_items_without_a_token_have_no_score(spark, tmp_path, blanks_labelled):
    got = {r.item_id: r for r in t.predictions(spark, folder(spark, tmp_path, blanks_labelled)).collect()}
    assert [*sorted(got)] == [*range(len(TEXTS) + (len(BLANK) if blanks_labelled else 0))]
    for i, text in enumerate(TEXTS):
        words = text.lower().split()
        assert got[i].p_base == pytest.approx(1 - len(set(words)) / len(words), abs=1e-6)
        assert got[i].p_micro is not None
    for i in range(len(TEXTS), len(got)):
        assert got[i].p_base is None and got[i].p_ens is None and got[i].p_micro is None


@pytest.mark.parametrize("name", ["false_positive_artifacts", "compare_cohorts", "mining_report"])
def test_unlabelled_blank_texts_change_nothing(spark, tmp_path, name):
    whole = folder(spark, tmp_path / "whole", False)
    spark.read.parquet(f"{whole}/documents.parquet").where(f"doc_id < {len(TEXTS)}").write.parquet(f"{tmp_path}/part/documents.parquet")
    spark.read.parquet(f"{whole}/labels.parquet").write.parquet(f"{tmp_path}/part/labels.parquet")
    got, want = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (whole, f"{tmp_path}/part"))
    assert want and got == want


def test_labelled_blank_texts_are_taken(spark, tmp_path):
    d = folder(spark, tmp_path, True)
    for name in ("false_positive_artifacts", "compare_cohorts", "mining_report", "roc_auc"):
        assert QUERIES[name](spark, d).collect()
