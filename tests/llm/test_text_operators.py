"""Operators on documents against plain versions, on awkward rows and on the smallest given tables."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from curatrix.llm import bpe, decontaminate, line_dedup, quality_rules, simhash, substring_dedup, token_counts
from curatrix.llm.common import maybe_in
from curatrix.llm.fm_index import FMIndex
from curatrix.llm.recompression import parse
from tests.llm import brute

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", params=["edge", "given"])
def docs(request, spark, data, edge_docs):
    return edge_docs if request.param == "edge" else spark.read.parquet(f"{data}/documents.parquet")


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_quality_rules(docs):
    got = Counter(pairs(quality_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == Counter((d, *brute.quality(t)) for d, t in pairs(docs, "doc_id", "text"))


def test_hosts_are_judged_with_a_prior(spark):
    good, bad = "w%d " * 60 % tuple(range(60)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "spam") for i in range(200)]
    rows += [(2000, good, "tiny"), (2001, bad, "small"), (2002, good, None)] + [(3000 + i, good, f"h{i}") for i in range(50)]
    out = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[i] == bool(i % 10) for i in range(200))
    assert not any(out[1000 + i] for i in range(200))
    assert out[2000] and not out[2001] and out[2002] and all(out[3000 + i] for i in range(50))


def test_keep_good_keeps_columns(edge_docs):
    kept = quality_rules.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    judged = Counter(r.doc_id for r in quality_rules.judge(edge_docs).where("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == judged


def test_token_counts(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((d, b, n, tuple(ids)) for d, b, n, ids in pairs(token_counts.encode(docs, MODEL, chunk=500, overlap=8), "doc_id", "n_bytes", "n_tokens", "ids"))
    want = Counter()
    for d, t in pairs(docs, "doc_id", "text"):
        ids = model.encode(t or "")
        want[d, len((t or "").encode()), len(ids), tuple(ids)] += 1
    assert got == want


def test_substrings(docs):
    known = docs.where("doc_id IS NOT NULL")
    got = pairs(substring_dedup.drop_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    want = brute.substrings(set(pairs(known, "doc_id", "text")))
    assert Counter(d for d, *_ in got) == Counter(d for d, in pairs(docs, "doc_id"))
    assert all(tuple(rest) == want[d] for d, *rest in got if d is not None)
    assert all(removed == 0 for d, _, removed, _ in got if d is None)


@pytest.mark.parametrize("window", [2, 7, 40])
def test_substrings_of_few_words(spark, window):
    draw = np.random.default_rng(window)
    rows = [(int(i), " ".join(draw.choice(["a", "b"], draw.integers(0, 120)))) for i in range(40)]
    got = {r[0]: tuple(r[1:]) for r in pairs(substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window), "doc_id", "n_words", "n_removed", "kept_sha256")}
    assert got == brute.substrings(rows, window)


def test_contexts_decide_symbols():
    """Where the context of a symbol occurs again, the symbol occurs again."""
    draw = np.random.default_rng(1)
    words = draw.integers(0, 4, 4000).astype(np.uint64)
    for s in parse(words, 3):
        assert (s.end[:-1] == s.start[1:]).all() and s.start[0] == 0 and s.end[-1] == len(words)
        assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
        there = {(int(a), int(b)): int(n) for a, b, n in zip(s.start, s.end, s.name)}
        contexts = {}
        for n, a, b, low, high in zip(s.name, s.start, s.end, s.low, s.high):
            if low >= 0 and high <= len(words):
                contexts.setdefault(words[low:high].tobytes(), []).append((int(low), int(a - low), int(b - low), int(n)))
        for places in contexts.values():
            for low, _, _, _ in places:
                for _, a, b, n in places:
                    assert there[low + a, low + b] == n


def test_lines(docs):
    rows = pairs(docs, "doc_id", "text", "source")
    got = Counter(pairs(line_dedup.drop_boilerplate(docs), "doc.doc_id", "doc.text"))
    assert got == Counter((d, t) for (d, _, _), t in zip(rows, brute.clean_lines(rows)))


def test_lines_keep_columns(edge_docs):
    out = line_dedup.drop_boilerplate(edge_docs).select("doc.*")
    assert out.columns == edge_docs.columns
    assert line_dedup.drop_boilerplate(edge_docs).where("n_dropped > 0").count() == 12


def test_bpe(docs):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = Counter((d, tuple(ids), bytes(raw)) for d, ids, raw in pairs(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "ids", "decoded"))
    assert got == Counter((d, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t in pairs(docs, "doc_id", "text"))


def test_bpe_forgets_without_harm():
    trees = bpe.SegmentTrees(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = ["the<|endoftext|> 's it's'LL ___ 123abc", "a" * 3000 + "\n\n  b", "=-" * 500, "\U0001F600\x1c\x85 é" * 30]
    first = trees.encode_many(texts)
    limit, bpe.REMEMBERED = bpe.REMEMBERED, 3
    try:
        assert [trees.encode_many([t])[0] for t in texts] == first
    finally:
        bpe.REMEMBERED = limit
    assert [trees.decode(i).decode() for i in first] == texts


@pytest.mark.parametrize("block_bytes", [8 << 20, 700])
def test_contamination(spark, docs, data, edge_docs, block_bytes):
    passage = next(r.text for r in edge_docs.where("doc_id = 11").collect())
    items = [(1, passage), (2, passage), (10, "one two"), (11, ""), (12, None), (13, "!!"), (None, "one"), (3, "same same")]
    items += pairs(spark.read.parquet(f"{data}/benchmark.parquet"), "item_id", "text") if docs is not edge_docs else []
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = pairs(decontaminate.find_contamination(docs, table, block_bytes=block_bytes), "doc_id", "n_words", "spans", "items")
    got = Counter((d, n, sum(b - a for a, b in spans), tuple(sorted(map(str, i)))) for d, n, spans, i in found)
    want = Counter()
    for d, t in pairs(docs, "doc_id", "text"):
        n, hit, own = brute.contamination([(d, t)], items)[d]
        want[d, n, hit, tuple(own)] += 1
    assert got == want


def test_index_finds_what_is_there():
    draw = np.random.default_rng(5)
    symbols = draw.integers(1, 5, 3000)
    ends = np.unique(np.append(draw.integers(1, 3000, 60), 3000))
    index = FMIndex(symbols, ends)
    patterns = draw.integers(1, 6, (50, 4))
    low, high = index.search(patterns)
    begins = np.concatenate([[0], ends[:-1]])
    for pattern, a, b in zip(patterns, low, high):
        want = [i for s, e in zip(begins, ends) for i in range(s, e - 3) if (symbols[i:i + 4] == pattern).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_simhash(docs):
    got = Counter((d, f"{fp & (1 << 64) - 1:016x}", c) for d, fp, c in pairs(simhash.near_duplicates(docs), "doc_id", "fp", "component_id"))
    assert got == Counter(brute.components(pairs(docs, "doc_id", "text")))


def test_links_in_a_crowd():
    draw = np.random.default_rng(2)
    values = np.unique(draw.integers(0, 1 << 16, 300))
    parent = {int(v): int(v) for v in values}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.links_within(values):
        assert top(a) != top(b)
        parent[top(a)] = top(b)
    chance = {int(v): int(v) for v in values}

    def top2(x):
        while chance[x] != x:
            x = chance[x]
        return x

    for a in values.tolist():
        for b in values.tolist():
            if (a ^ b).bit_count() <= 2:
                chance[top2(a)] = top2(b)
    groups = lambda f: {frozenset(v for v in values.tolist() if f(v) == r) for r in {f(v) for v in values.tolist()}}
    assert groups(top) == groups(top2)


def test_empty_tables(no_docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        quality_rules.judge(no_docs), quality_rules.keep_good(no_docs), token_counts.encode(no_docs, MODEL), substring_dedup.drop_repeats(no_docs),
        line_dedup.drop_boilerplate(no_docs), bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN), decontaminate.find_contamination(no_docs, items),
        decontaminate.drop_contaminated(no_docs, items), simhash.near_duplicates(no_docs)):
        assert out.count() == 0


def test_no_benchmark(edge_docs, spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(edge_docs, items).count() == edge_docs.count()


def test_bitmap_lets_through_all_that_are_there(spark):
    rows, ids = spark.range(-20_000, 20_000).withColumnRenamed("id", "doc_id"), spark.range(-900, 900, 7).withColumnRenamed("id", "doc_id")
    passed = maybe_in(rows, ids, "doc_id")
    assert passed.join(ids, "doc_id").count() == ids.count() == passed.join(ids, "doc_id", "left_semi").count()
    assert passed.count() < ids.count() + 200 and maybe_in(rows, ids.limit(0), "doc_id").count() == 0
