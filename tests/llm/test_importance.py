"""Importance resampling against a plain version: all windows as strings, hashed by zlib."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from curatrix.llm import importance
from tests.llm import brute


def windows(text):
    words = brute.ITEM_WORD.findall((text or "").translate(brute.LOWER))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def by_hand(docs, items):
    """docs: (id, text) -> sorted (id, features, weight, score, rank)."""
    found = [(d, *windows(t)) for d, t in docs]
    s, t = Counter(b for _, _, w in found for b in w), Counter(b for x in items for b in windows(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (total_s + 10000.0) / ((s[b] + 1.0) * (total_t + 10000.0)))) for b in range(10000)]
    rows = []
    for d, n, w in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in w)
        rows.append((d, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:5 * len(able) // 100]
    rest = able[len(drawn):] + [r for r in rows if r[4] < 20]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in rest], key=str)


def got(docs, items):
    return sorted(map(tuple, importance.resample(docs, items).drop("n_words").collect()), key=str)


def test_crc_of_windows():
    draw = random.Random(2)
    words = ["".join(draw.choices("abcé日9", k=draw.choice([1, 2, 3, 9, 300]))).encode() for _ in range(200)]
    owner = np.sort(np.array(draw.choices(range(9), k=200)))
    who, found = importance.window_buckets(words, owner, np.ones(200, bool))
    want = Counter((int(owner[i]), zlib.crc32(b" ".join(words[i:i + k])) % 10000) for k in (1, 2, 3) for i in range(201 - k) if owner[i] == owner[i + k - 1])
    assert Counter(zip(who.tolist(), found.tolist())) == want


def test_given_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    want = by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in items.select("text").collect()])
    assert sum(r[4] is not None for r in want) > 3
    assert got(docs, items) == want


@pytest.mark.parametrize("piece, words", [(256 << 10, 1 << 16), (40, 7)])
def test_awkward_rows(spark, edge_docs, no_docs, monkeypatch, piece, words):
    monkeypatch.setattr(importance, "PIECE_BYTES", piece)
    monkeypatch.setattr(importance, "WORDS", words)
    items = spark.createDataFrame([("a", "Same same, SAME same!"), ("b", None), (None, ""), ("c", "日本語 テキスト")], "item_id string, text string")
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    want = by_hand(rows, [r.text for r in items.collect()])
    assert got(edge_docs, items) == want
    assert got(no_docs, items) == []
    assert got(edge_docs, items.limit(0)) == by_hand(rows, [])


def test_ranks_over_many_ranges(spark):
    """Ties over partitions: one text for all, so that only the noise and the id decide; repeated rows stand behind each other."""
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(i // 3, text if i % 7 else "short") for i in range(900)] + [(None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = importance.resample(docs, docs.limit(0), percent=50)
    ranks = [(r.rank, r.score, r.doc_id) for r in out.collect() if r["rank"] is not None]
    ranks.sort()
    assert [r[0] for r in ranks] == list(range(1, len(ranks) + 1)) and len(ranks) == sum(t == text for _, t in rows) // 2
    assert all((-a[1], a[2]) <= (-b[1], b[2]) for a, b in zip(ranks, ranks[1:]))
