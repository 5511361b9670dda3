"""The pipeline against its stages done by hand."""

from __future__ import annotations

from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from curatrix.llm import bpe
from tests.llm import brute
from tests.llm.test_near_text import kept_by_hand


def clean_lines(rows, ratio=0.1, least=5):
    """rows: (id, text, host) -> texts without lines that too many different texts of their host have."""
    pages = {}
    for _, text, host in rows:
        pages.setdefault(host, set()).add(text)
    lines = {h: Counter(x for t in texts for x in set((t or "").split("\n")) if brute.WORD.search(x)) for h, texts in pages.items()}
    return [t if t is None or h is None else "\n".join(x for x in t.split("\n") if lines[h][x] < least or lines[h][x] <= ratio * len(pages[h]))
            for _, t, h in rows]


def by_hand(docs, items):
    """docs: (id, text, host); no host fails often enough here to be rejected."""
    rows = [r for r in docs if not brute.quality(r[1])[-1]]
    rows = [(d, t) for (d, _, _), t in zip(rows, clean_lines(rows))]
    kept = {d for d, _ in kept_by_hand(rows)}
    rows = [r for r in rows if r[0] in kept]
    found = brute.contamination(rows, items)
    rows = [r for r in rows if not found[r[0]][1]]
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return {d: encoding.encode_ordinary(t) for d, t in rows}


def test_pipeline(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, data).collect()}
    assert 0 < len(got) < len(docs)
    assert got == by_hand(docs, items)


def test_stages_keep_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert all(r.n_chars == len(r.text) for r in out.select("n_chars", "text").collect())


def test_stages_on_awkward_rows(spark, data, edge_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(*columns), no_docs.select(*columns)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, data)
        assert docs.columns == ["doc_id", "ids"]
