"""Plain versions of the operators for small tables, written from the definitions alone."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    triples = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if triples[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def clean_lines(rows, ratio=0.1, least=5):
    """rows: (id, text, host) -> texts without boilerplate."""
    total, pages = Counter(h for _, _, h in rows), Counter()
    for _, text, host in rows:
        for line in set((text or "").split("\n")):
            if WORD.search(line):
                pages[host, line] += 1
    bad = {k for k, n in pages.items() if k[0] is not None and n >= least and n > ratio * total[k[0]]}
    return [text if text is None else "\n".join(x for x in text.split("\n") if (host, x) not in bad) for _, text, host in rows]


def substrings(rows, window=20):
    first, out = {}, {}
    texts = sorted((d, tuple(words(t))) for d, t in rows)
    for d, w in texts:
        for i in range(len(w) - window + 1):
            first.setdefault(w[i:i + window], (d, i))
    for d, w in texts:
        gone = {i + k for i in range(len(w) - window + 1) if first[w[i:i + window]] != (d, i) for k in range(window)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, window=10):
    owners = defaultdict(set)
    for item, text in items:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            owners[tuple(w[i:i + window])].add(str(item))
    lengths, out = {len(k) for k in owners}, {}
    for d, text in docs:
        w, hit, found = ITEM_WORD.findall((text or "").translate(LOWER)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                own = owners.get(tuple(w[i:i + n]))
                if own:
                    hit.update(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(found))
    return out


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, distance=2):
    """rows: (id, text) -> {id: (hex fingerprint, smallest reachable id)}"""
    prints = [(d, fingerprint(t)) for d, t in rows]
    root = {f: f for _, f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                root[top(a)] = top(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[top(f)] = min(least.get(top(f), d), d)
    return [(d, f"{f:016x}", least.get(top(f))) for d, f in prints]
