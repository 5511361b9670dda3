"""Exact removal of long word sequences that were seen before, found by recompression.

Three steps, each over all documents:

1. Every document is recompressed. Each window of ``WINDOW`` words picks one of the symbols whose context lies in the
   window, so equal windows pick equal symbols. Keys (the named contexts) of picked symbols that occur once in the
   corpus prove their windows unique; the others reveal where text may repeat.
2. Only windows behind a repeated key, and the few that hold no whole context, are named by 96 bits and compared;
   the first in the order of (document, start) stays.
3. The words of all other such windows are cut.

Copies of a whole document are settled by their digest beforehand. A task sends a key or a window once however often
it has it, and settles its own repetitions itself, so a passage that everybody has is at most one row of each task's
batches. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import WordNames, maybe_in, mix, raw, spans, written
from curatrix.llm.recompression import Symbols, parse

WINDOW = 20
ROUNDS = 2
BATCH_BYTES = 1 << 20

KEYS_DDL = "doc_id long, n_words long, sha string, sent array<long>, found array<long>, loose boolean"
WINDOWS_DDL = "doc_id long, raw binary, cut array<int>, starts array<int>, names array<long>, checks array<int>"
CUT_DDL = "doc_id long, n_removed long, sha string, kept binary"


class Batch:
    """The words of some documents in one sequence; a symbol of its own stands between two documents."""

    def __init__(self, texts: list[bytes | None], names: WordNames):
        self.joined = [b" ".join((t or b"").split()) for t in texts]
        self.names = names
        parts, sizes = [], []
        for i, text in enumerate(self.joined):
            sizes.append(text.count(b" ") + 1 if text else 0)
        whole = b" ".join(t if t else b"" for t in self.joined)
        words = whole.split()
        begin, end = spans(words)
        packed = np.frombuffer(b" ".join(words), np.uint8)
        parts = np.empty(len(words), np.uint64)
        at = 0
        while at < len(words):  # in pieces, so that a very long text takes no more memory than others
            to = max(at + 1, int(np.searchsorted(end, begin[at] + BATCH_BYTES)))
            base = begin[at]
            parts[at:to] = names(packed[base:end[to - 1]], begin[at:to] - base, end[at:to] - base)
            at = to
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int((self.sizes + 1).sum())
        self.doc = np.repeat(np.arange(len(texts)), self.sizes + 1)
        fence = np.zeros(n, bool)
        fence[self.first + self.sizes] = True
        self.words = np.empty(n, np.uint64)
        self.words[~fence] = parts
        self.words[fence] = mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(0xF3))

    def windows(self, window: int) -> np.ndarray:
        """Starts of all windows that lie inside one document."""
        inside = np.maximum(self.sizes - window + 1, 0)
        ends = np.cumsum(inside)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first - (ends - inside), inside)

    def picked(self, starts: np.ndarray, window: int, rounds: int) -> tuple[Symbols, np.ndarray]:
        """Symbols, and for each window the one it picks (-1: it holds no whole context)."""
        s = parse(self.words, rounds)[-1]
        fits = np.flatnonzero(s.high - s.low <= window)
        s = Symbols(*(getattr(s, f)[fits] for f in ("name", "start", "end", "low", "high")))
        if not len(s) or not len(starts):
            return s, np.full(len(starts), -1, np.int64)
        value = mix(s.name ^ np.uint64(0xA5A5A5A5))
        best = [np.arange(len(s))]
        while 1 << len(best) <= window:
            half, last = 1 << len(best) - 1, best[-1]
            left, right = last, np.append(last[half:], np.full(min(half, len(last)), last[-1]))
            best.append(np.where(value[left] <= value[right], left, right))
        low, high = np.searchsorted(s.low, starts), np.searchsorted(s.high, starts + window, side="right")
        count = high - low
        some = count > 0
        level = np.zeros(len(starts), np.int64)
        level[some] = np.frexp(count[some].astype(float))[1] - 1
        table = np.stack(best)
        left = table[level, np.minimum(low, len(s) - 1)]
        right = table[level, np.maximum(high - (1 << level), 0)]
        return s, np.where(some, np.where(value[left] <= value[right], left, right), -1)

    def keys(self, s: Symbols, which: np.ndarray) -> np.ndarray:
        """Names of the contexts of some symbols."""
        self.names._grow(len(self.words) + 1)
        power, inverse = self.names.power[0], self.names.inverse[0]
        sums = np.zeros(len(self.words) + 1, np.uint64)
        np.cumsum(self.words * power[:len(self.words)], out=sums[1:])
        low, high = s.low[which], s.high[which]
        return mix((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))

    def window_names(self, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """96-bit names of windows: two sums of the words times random numbers."""
        draws = np.random.default_rng(20).integers(0, 1 << 64, (2, window), np.uint64) | np.uint64(1)
        sums = [np.zeros(len(starts), np.uint64) for _ in draws]
        for i in range(window):
            word = self.words[starts + i]
            for total, draw in zip(sums, draws):
                total += word * draw[i]
        return mix(sums[0]), (mix(sums[1]) >> np.uint64(32)).astype(np.uint32)


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
            rows.append(tuple(v.as_py() for v in row))
            size += len(rows[-1][column] or b"") + 64
            if size >= BATCH_BYTES:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values by owner (ascending) as one list for each of ``n`` rows."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def document_keys(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Step 1, from (doc_id, raw): number and digest of the words, keys to compare with other tasks, keys that
    this batch has more than once, and whether some window picks no symbol."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for rows in _batches(batches, 1):
            b = Batch([r[1] for r in rows], names)
            starts = b.windows(window)
            s, pick = b.picked(starts, window, rounds)
            used = np.unique(pick[pick >= 0])
            keys = b.keys(s, used)
            owner = b.doc[s.low[used]]
            _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
            repeated = count[back] > 1
            sent = np.zeros(len(keys), bool)
            sent[first] = True
            loose = np.bincount(b.doc[starts[pick < 0]], minlength=len(rows)) > 0
            signed = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array(b.sizes),
                pa.array([hashlib.sha256(t).hexdigest() for t in b.joined]),
                _lists(owner[sent], signed[sent], len(rows), pa.int64()),
                _lists(owner[repeated], signed[repeated], len(rows), pa.int64()), pa.array(loose)],
                ["doc_id", "n_words", "sha", "sent", "found", "loose"])

    return docs.mapInArrow(run, KEYS_DDL)


def candidate_windows(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Step 2, from (doc_id, raw, keys): starts that this batch settles itself, and the windows to compare with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = WordNames()
        for rows in _batches(batches, 1):
            rows.sort(key=lambda r: r[0])
            b = Batch([r[1] for r in rows], names)
            starts = b.windows(window)
            s, pick = b.picked(starts, window, rounds)
            used, back = np.unique(pick, return_inverse=True)
            real = used >= 0
            hit = ~real
            if real.any():
                own = mix(b.keys(s, used[real]) + b.doc[s.low[used[real]]].astype(np.uint64))
                told = np.concatenate([mix(np.array(r[2] or [], np.int64).view(np.uint64) + np.uint64(i)) for i, r in enumerate(rows)])
                hit[real] = np.isin(own, told)
            starts = starts[hit[back]] if len(used) else starts
            name, check = b.window_names(starts, window)
            doc = b.doc[starts]
            ids = np.array([r[0] for r in rows], np.int64)
            order = np.lexsort((starts, check, name))
            head = np.ones(len(order), bool)
            head[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
            lead = np.empty(len(order), np.int64)
            lead[order] = order[head][np.cumsum(head) - 1]
            offset = starts - b.first[doc]
            # Rows are in the order of ids, so the first start of a name is the earliest; a repeated row is no earlier text.
            same = np.arange(len(starts)) == lead
            cut = ~same & ~((ids[doc] == ids[doc[lead]]) & (offset == offset[lead]))
            keep = np.flatnonzero(np.bincount(doc, minlength=len(rows)))
            renumber = np.cumsum(np.bincount(keep, minlength=len(rows))) - 1
            n = len(keep)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[keep]), pa.array([b.joined[i] for i in keep], pa.binary()),
                _lists(renumber[doc[cut]], offset[cut].astype(np.int32), n, pa.int32()),
                _lists(renumber[doc[same]], offset[same].astype(np.int32), n, pa.int32()),
                _lists(renumber[doc[same]], name[same].view(np.int64), n, pa.int64()),
                _lists(renumber[doc[same]], check[same].view(np.int32), n, pa.int32())],
                ["doc_id", "raw", "cut", "starts", "names", "checks"])

    return docs.mapInArrow(run, WINDOWS_DDL)


def cut_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Step 3, from (doc_id, raw, cut, more): the words under the given windows go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, here, more in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array((here or []) + (more or []), np.int64))
                change[at] += 1
                change[at + window] -= 1
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                left = b" ".join([words[i] for i in kept.tolist()])
                out.append((key, len(words) - len(kept), hashlib.sha256(left).hexdigest(), left))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["doc_id", "n_removed", "sha", "kept"])

    return docs.mapInArrow(run, CUT_DDL)


def repeated_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                  rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """What repeats: (doc_id, n_words, sha, copy_of) of every row, and (doc_id, n_removed, sha, kept) of documents that
    hold a repeated window without being copies.

    ``copy_of`` is the smallest id with the very same words. Null and empty texts have no words, and texts of fewer
    words than a window have none to remove. Repeated rows are one document: they are no earlier text for each other. A
    row with a null id is left whole and is no earlier text for others. Ids name one text each. Extra columns are
    not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"))
    seen = written(document_keys(source, window, rounds), "document-keys")
    whole = seen.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    # Written, so that the join below gets exchanges of its own, whose large partitions (a text with many copies) are split.
    first = written(whole.groupBy("sha").agg(F.min("doc_id").alias("copy_of")), "first-copies")
    digest = written(
        seen.select("doc_id", "n_words", "sha").join(first, "sha", "left").withColumn(
            "copy_of", F.when(F.col("n_words") >= window, F.col("copy_of"))), "digests")
    copies = digest.where("doc_id <> copy_of").select("doc_id").distinct()

    key = Window.partitionBy("key").orderBy("doc_id")
    sent = whole.select("doc_id", F.explode("sent").alias("key"))
    shared = sent.select("doc_id", "key", (F.lag("key").over(key).isNotNull() | F.lead("key").over(key).isNotNull()).alias("hit"))
    told = shared.where("hit").select("doc_id", "key").unionByName(
        whole.select("doc_id", F.explode_outer("found").alias("key"), "loose").where("loose OR key IS NOT NULL").select("doc_id", "key"))
    asked = written(told.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).join(copies, "doc_id", "left_anti"), "asked")
    windows = written(candidate_windows(maybe_in(source, asked, "doc_id").join(asked, "doc_id"), window, rounds), "windows")

    name = Window.partitionBy("name", "check").orderBy("doc_id", "start")
    exploded = windows.select("doc_id", F.explode(F.arrays_zip("starts", "names", "checks")).alias("w")).select(
        "doc_id", F.col("w.starts").alias("start"), F.col("w.names").alias("name"), F.col("w.checks").alias("check"))
    later = exploded.select("doc_id", "start", F.rank().over(name).alias("place")).where("place > 1").groupBy("doc_id").agg(
        F.collect_set("start").alias("more"))
    cut = cut_words(windows.select("doc_id", "raw", "cut").join(later, "doc_id", "left").where("more IS NOT NULL OR size(cut) > 0"), window)
    return digest, cut


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row; see ``repeated_text``."""
    digest, cut = repeated_text(docs, id_col, text_col, window, rounds)
    cut = written(cut.select("doc_id", "n_removed", F.col("sha").alias("cut_sha")), "cuts").dropDuplicates(["doc_id"])
    copy = F.coalesce(F.col("doc_id") != F.col("copy_of"), F.lit(False))
    return digest.join(cut, "doc_id", "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"))
