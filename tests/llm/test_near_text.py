"""Near copies by five-word Jaccard against brute force: every pair of 0.8 or more, and no other."""

from __future__ import annotations

import random

import numpy as np
import pytest

from curatrix.llm import near_text
from tests.llm import brute


def shingles(text):
    w = brute.words((text or "").translate(brute.LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_hand(rows):
    """rows: (id, text) -> ids and texts that stay, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[top(i)] = top(j)
    least = {}
    for i, (d, t) in enumerate(rows):
        least.setdefault(top(i), []).append((d is None, d or 0, t or ""))
    return sorted(min(g)[1:] for g in least.values())


def near_copies():
    """Texts with copies of which up to 14 words differ, one by one and in a run, a cloud around one text, and a line that all have."""
    draw = random.Random(8)
    vocabulary = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(3000)]
    line = " ".join(draw.choices(vocabulary, k=12))
    texts = []
    for k in range(40):
        base = draw.choices(vocabulary, k=draw.randint(60, 260))
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for at in draw.sample(range(len(base)), k=draw.randint(1, 14)):
                copy[at] = draw.choice(vocabulary)
            texts.append(copy)
        texts.append(base[:len(base) - draw.randint(1, 40)])
    cloud = draw.choices(vocabulary, k=200)
    for _ in range(60):
        copy = list(cloud)
        for at in draw.sample(range(200), k=draw.randint(1, 6)):
            copy[at] = draw.choice(vocabulary)
        texts.append(copy)
    texts = [" ".join(t) + (f"\n{line}" if i % 2 else "") for i, t in enumerate(texts)]
    return [*enumerate(texts), (900, "one two"), (901, "ONE two"), (902, None), (903, " "), (904, "one two three four five six")]


@pytest.mark.parametrize("pivots, common", [(4, 1 << 17), (1, 0)])
def test_every_near_copy_is_found(spark, monkeypatch, pivots, common):
    monkeypatch.setattr(near_text, "PIVOTS", pivots)
    if not common:
        monkeypatch.setattr(near_text, "common_shingles", lambda *_: np.empty(0, np.int64))
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in near_text.keep_first(docs).collect())
    want = kept_by_hand(rows)
    assert 60 < len(want) < len(rows) - 60
    assert got == want


def test_given_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.text or "") for r in near_text.keep_first(docs).collect()) == kept_by_hand(rows)


def test_null_and_shared_ids(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " end"), (7, other), (7, "another text of its own"), (8, other), (None, other)]
    out = near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(got) == 3 and got[0] == (7, "another text of its own") and got[1] == (7, other) and got[2][0] is None


def test_tallies_never_rule_out_a_near_copy():
    draw = np.random.default_rng(5)

    def drawn(n):
        return np.unique(draw.integers(-1 << 63, (1 << 63) - 1, n))

    for n in (1, 2, 3, 7, 8, 31, 100, 511, 512, 513, 4000):
        for lost in range(0, n, max(1, n // 20)):
            both, mine, other = drawn(n), drawn(lost), drawn(lost // 2)
            a, b = np.unique(np.concatenate([both, mine])), np.unique(np.concatenate([both, other]))
            if near_text.alike(a, b):
                assert near_text.may_be_alike(near_text.tally(a), near_text.tally(b))
    for n in (500, 4000):
        assert not near_text.may_be_alike(near_text.tally(drawn(n)), near_text.tally(drawn(n)))
    same_end = np.arange(2000, dtype=np.int64) << 20
    assert near_text.tally(same_end) == b"" and near_text.may_be_alike(b"", near_text.tally(drawn(4)))


def test_simhash_names_pairs_first(spark):
    """Sets whose fingerprints are at most two bits apart are connected by the operator's pairs, and by no others."""
    rows = [(i, t) for i, t in enumerate(near_copies())]
    draw = random.Random(3)
    long = draw.choices(["".join(draw.choices("abcdefgh", k=6)) for _ in range(2000)], k=1500)
    rows += [(len(rows) + k, " ".join(long[:700 + 20 * k] + ["new"] + long[701 + 20 * k:])) for k in range(12)]
    names = near_text.named(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    sets = {bytes(r.node): r.fp & (1 << 64) - 1 for r in names}
    table = spark.createDataFrame([(r.node, r.fp) for r in names], "node binary, fp long").distinct()

    def joined(pairs):
        root = {n: n for n in sets}

        def top(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            root[top(a)] = top(b)
        groups = {}
        for n in sets:
            groups.setdefault(top(n), set()).add(n)
        return sorted(map(sorted, groups.values()))

    want = joined((a, b) for a in sets for b in sets if a < b and (sets[a] ^ sets[b]).bit_count() <= 2)
    assert len(want) < len(sets) - 5
    assert joined((bytes(r.a), bytes(r.b)) for r in near_text.fingerprint_pairs(table).collect()) == want


def loose_cloud(n):
    """Copies of one text with 1 to 8 new words each: few are alike, and all have shingles in common."""
    draw = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for i in range(n):
        copy = list(base)
        for k, at in enumerate(draw.sample(range(150), k=draw.choice((1, 5, 6, 7, 8)))):
            copy[at] = f"n{i}x{k}"
        texts.append(" ".join(copy))
    return list(enumerate(texts))


def test_loose_cloud_makes_few_pairs(spark, monkeypatch):
    """The rows of pairs grow with the texts, though most of them are compared with one another."""
    named, possible = [], near_text.possible

    def counted(pairs, sets):
        named.append(pairs.count())
        return possible(pairs, sets)

    monkeypatch.setattr(near_text, "possible", counted)
    rows = loose_cloud(260)
    got = sorted((r.doc_id, r.text) for r in near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == kept_by_hand(rows)
    assert 100 < len(got) < 250
    assert sum(named) < 20 * len(rows)


@pytest.mark.parametrize("place_bytes", [4 << 20, 30_000])
def test_crowds_lose_nothing(spark, monkeypatch, place_bytes):
    """All postings as crowds: clouds that fit a task, and clouds that are cut to postings and these to tiles."""
    monkeypatch.setattr(near_text, "CROWDED", 2)
    monkeypatch.setattr(near_text, "PLACE_BYTES", place_bytes)
    rows = near_copies() + [(1000 + i, t) for i, t in loose_cloud(50)]
    got = sorted((r.doc_id, r.text or "") for r in near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == kept_by_hand(rows)


def test_forest_joins_what_is_alike():
    draw = np.random.default_rng(7)
    pool = draw.integers(-1 << 63, (1 << 63) - 1, 60)
    sets = [np.unique(draw.choice(pool[:draw.integers(8, 60)], draw.integers(4, 50))) for _ in range(120)]
    for sides in (None, np.arange(120) % 2):
        want = {(i, j) for i in range(120) for j in range(i) if near_text.alike(sets[i], sets[j]) and (sides is None or sides[i] != sides[j])}
        edges = near_text.forest(sets, np.arange(120), sides)
        assert want and {(max(e), min(e)) for e in edges} <= want

        def groups(pairs):
            label = list(range(120))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        assert groups(edges) == groups(want)
        assert len(edges) == 120 - len(set(groups(want)))


def recorded(monkeypatch, name):
    """Rows of the tables that are written under ``name``, as they come."""
    counts, written = [], near_text.written

    def counted(df, to):
        out = written(df, to)
        if to == name:
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_text, "written", counted)
    return counts


def test_large_cloud_is_not_sent_for_each_posting(spark, monkeypatch):
    """A cloud that is too much for a task, whose texts are together in many postings, moves once for each of its tiles."""
    monkeypatch.setattr(near_text, "PLACE_BYTES", 60_000)
    sent = recorded(monkeypatch, "places")
    rows = loose_cloud(260)
    got = sorted((r.doc_id, r.text) for r in near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == kept_by_hand(rows)
    tiles = -(-2 * 260 * (8 * 146 + 64) // 60_000)
    assert 0 < sum(sent) <= tiles * len(rows)


def test_texts_with_one_passage_in_common_do_not_meet_whole(spark, monkeypatch):
    """Crowds that tallies take apart: no whole set is sent."""
    monkeypatch.setattr(near_text, "common_shingles", lambda *_: np.empty(0, np.int64))
    met, sent = recorded(monkeypatch, "tally-places"), recorded(monkeypatch, "crowd-wanted")
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"n{i}x{k}" for k in range(200 + i)) + " " + passage) for i in range(80)]
    out = near_text.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == rows
    assert met == [79] and sent == [0]  # the first is done with by then


def test_close_forest_joins_what_tallies_allow():
    draw = np.random.default_rng(9)
    pool = draw.integers(-1 << 63, (1 << 63) - 1, 400)
    sets = [np.unique(draw.choice(pool[:draw.integers(8, 400)], draw.integers(1, 300))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[len(s) // draw.integers(5, 40):], draw.integers(0, 1 << 62, draw.integers(0, 9))])) for s in sets[:60]]
    sets += [np.arange(n, dtype=np.int64) << 20 for n in (300, 330, 900)]
    tallies, sizes = [near_text.tally(s) for s in sets], np.array([*map(len, sets)])
    assert b"" in tallies
    n = len(sets)
    components = draw.integers(0, n // 2, n)
    for sides in (None, np.arange(n) % 2):
        want = [(i, j) for i in range(n) for j in range(i) if components[i] != components[j] and (sides is None or sides[i] != sides[j])
                and near_text.may_be_alike(tallies[i], tallies[j]) and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])]
        edges = near_text.close_forest(tallies, sizes, components, sides)
        assert want and {(max(e), min(e)) for e in edges} <= {*want}

        def groups(pairs):
            label = list(range(n))
            for a, b in pairs:
                label = [label[a] if x == label[b] else x for x in label]
            return [label.index(x) for x in label]

        assert groups(edges) == groups(want)
        assert len(edges) == n - len(set(groups(want)))
