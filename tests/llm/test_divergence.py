"""Divergence of sources against a plain version with whole numbers of any size."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from curatrix.llm import divergence
from tests.llm import brute

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, min_docs=10, top=10):
    """rows: (text, lang, source) -> sorted (lang, source, part, item, value, rank)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(brute.LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            stand = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", stand)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def got(docs, **options):
    return sorted(map(tuple, divergence.audit(docs, **options).collect()))


def test_shares_of_large_counts():
    counts = np.array([0, 1, 7 * 10 ** 14, 10 ** 15 - 2])
    assert divergence.share(counts, 10 ** 15).tolist() == [1 + 10 ** 9 * (c + 2) // 10 ** 15 for c in counts.tolist()]


@pytest.mark.parametrize("sources, cells, batch", [(256, 1 << 18, 4 << 20), (2, 6, 300)])
def test_sources_in_blocks_and_shards(spark, monkeypatch, sources, cells, batch):
    for name, value in (("SOURCES", sources), ("CELLS", cells), ("BATCH_BYTES", batch)):
        monkeypatch.setattr(divergence, name, value)
    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcÄßé", k=draw.randint(1, 3))) for _ in range(60)]
    rows = []
    for i in range(300):
        host = draw.choice(["a", "a", "a", "b", "é", "Z", None, "zz", "b "])
        words = draw.choices(vocabulary[:40] if host == "a" else vocabulary[10:], k=draw.randint(0, 40))
        rows.append((draw.choice([" ", "-1", "\n"]).join(words), draw.choice(["en", "en", "de", None]), host))
    rows += [(None, "en", "empty"), ("", "none", "x"), (None, "none", "y"), ("Rare words", "one", "only"), *[("same Same", "one", "only")] * 12]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert got(docs) == by_hand(rows)
    assert got(docs, min_docs=1, top=2) == by_hand(rows, 1, 2)


def test_words_longer_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BATCH_BYTES", 100)
    rows = [("é" * 400 + " X" * 300 + "\x7f" + "ab" * 250, "en", "a"), ("é" * 400, "en", "b"), ("x ab", "en", "b"), ("", "en", "c"), ("X", "de", "a")]
    assert got(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1), min_docs=1) == by_hand(rows, 1)


def test_counting_takes_no_more_than_a_few_times_a_plain_loop():
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(30_000)]
    texts = [" ".join(draw.choices(vocabulary, k=300)).title() for _ in range(2_000)]
    docs = pa.table({"text": texts, "lang": ["en", "de"] * 1_000, "source": [f"s{i % 20}" for i in range(2_000)]}).cast(
        pa.schema([(c, pa.large_string()) for c in ("text", "lang", "source")]))

    def by_arrow():
        return {(r["lang"], r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence._counted(docs).to_pylist() if r["term"] is not None}

    n, seen = Counter(), Counter()
    for r in docs.to_pylist():
        for term, k in Counter(TERM.findall(r["text"].translate(brute.LOWER))).items():
            n[r["lang"], r["source"], term] += k
            seen[r["lang"], r["source"], term] += 1
    assert by_arrow() == {k: (n[k], seen[k]) for k in n}

    def seconds(run):
        times = []
        for _ in range(3):
            start = time.process_time()
            run()
            times.append(time.process_time() - start)
        return min(times)

    assert seconds(lambda: divergence._counted(docs)) < 3 * seconds(lambda: [Counter(TERM.findall(t.translate(brute.LOWER))) for t in texts])


def test_awkward_rows(edge_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in edge_docs.select("text", "lang", "source").collect()]
    assert got(edge_docs, min_docs=2) == by_hand(rows, 2)
    assert got(no_docs) == []
