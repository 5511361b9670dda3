"""Words whose names collided under polynomials modulo 2^64, clashing columns, and items without an id."""

from __future__ import annotations

from curatrix.llm import decontaminate, near_text, substring_dedup
from curatrix.llm.queries import op8


def thue_morse(size):
    return "".join("ab"[i.bit_count() & 1] for i in range(size))


X = thue_morse(1024)
Y = X.translate(str.maketrans("ab", "ba"))


def test_substring_dedup_of_colliding_words(spark):
    front, back = " ".join(f"w{i}" for i in range(10)), " ".join(f"v{i}" for i in range(9))
    rows = [(1, f"{front} {X} {back}"), (2, f"{front} {Y} {back}")]
    out = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 0}


def test_contamination_of_colliding_words_and_null_items(spark):
    docs = [(1, f"a {X} b"), (2, f"a {Y} b"), (3, "nothing of it"), (4, "this has no owner at all")]
    items = [("y", Y), (None, "no owner at all")]
    got = decontaminate.find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {r.doc_id: list(r["items"]) for r in got} == {1: [], 2: ["y"], 3: [], 4: [None]}
    assert {r.doc_id: [list(s) for s in r.spans] for r in got} == {1: [], 2: [[1, 2]], 3: [], 4: [[2, 6]]}


def test_clashing_columns(spark):
    names = ["_gone", "_id", "_of", "_digest", "digest", "doc", "key", "gone", "_bucket", "_hit", "mark_doc_id", "node", "raw"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, *["mine"] * len(names)) for i, t in enumerate([text, text + " end", "an item here", "other words " * 5])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *[f"{n} string" for n in names]]))
    items = spark.createDataFrame([("x", "an item here")], "item_id string, text string")
    kept = near_text.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [0, 1, 3]
    assert {tuple(r)[2:] for r in kept.collect() + clean.collect()} == {("mine",) * len(names)}


def test_query_counts_windows_of_null_items(spark, tmp_path):
    spark.createDataFrame([(1, "one two three")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "two three")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = op8(spark, str(tmp_path)).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (2, 1, True)
