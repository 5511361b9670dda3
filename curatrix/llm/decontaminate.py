"""Benchmark decontamination with one FM-index per training shard.

The benchmark is the query set. Its windows are numbered words; a shard of a few megabytes of documents keeps
the runs of words that the benchmark has at all (no window can reach over any other word), indexes them
and answers every window by backward search. The benchmark is taken in blocks of bounded size, so nothing
that is sent to the executors grows with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import ASCII_LOWER, Out, WordNames, raw
from curatrix.llm.fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

#: Bytes of words: digits, a-z and everything beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Every other byte as a space, so that ``split`` cuts at them.
CUT = bytes(b if ok else 32 for b, ok in enumerate(IN_WORD))

RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))),
    ("items", pa.list_(pa.string())), ("digest", pa.binary())])
RESULT_DDL = "doc_id long, n_words long, spans array<array<long>>, items array<string>, digest binary"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ASCII_LOWER).translate(CUT).split()


def id_order(item: str | None) -> tuple[bool, str]:
    """Ids in order, a missing one last."""
    return item is None, item or ""


class Windows:
    """The windows of a block of items: words as numbers from 1, one matrix for each window length."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners[tuple(words[i:i + window])].add(item)
        self.words = sorted({w for key in owners for w in key})
        number = {w: i + 1 for i, w in enumerate(self.words)}
        lengths: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for key in owners:
            lengths[len(key)].append(key)
        self.patterns = {n: np.array([[number[w] for w in key] for key in keys], np.int64) for n, keys in lengths.items()}
        self.owners = {n: [sorted(owners[key], key=id_order) for key in keys] for n, keys in lengths.items()}
        self.shortest = min(lengths, default=0)


def _pieces(flags: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that begin and end outside words."""
    start, n = 0, len(flags)
    while start < n:
        end = min(n, start + size)
        if end < n:
            outside = np.flatnonzero(~flags[start:end])
            if len(outside):
                end = start + int(outside[-1]) + 1
            else:
                later = np.flatnonzero(~flags[end:])
                end = end + int(later[0]) + 1 if len(later) else n
        yield start, end
        start = end


class Shard:
    """The words of some documents: where each begins, and its number in the benchmark (0: not in it)."""

    def __init__(self, texts: list[bytes], vocabulary: np.ndarray, numbers: np.ndarray, names: WordNames):
        joined = b"\n".join(texts).translate(ASCII_LOWER)
        self.bytes = np.frombuffer(joined, np.uint8)
        heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
        starts, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        flags = IN_WORD[self.bytes]
        for a, b in _pieces(flags, SHARD_BYTES):
            edge = np.diff(np.concatenate([[False], flags[a:b], [False]]).view(np.int8))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            name = names(self.bytes[a:b], begin, end)
            at = np.minimum(np.searchsorted(vocabulary, name), len(vocabulary) - 1)
            ids.append(np.where(vocabulary[at] == name, numbers[at], 0))
            starts.append(begin + a)
        self.starts, self.ids = np.concatenate(starts), np.concatenate(ids)
        #: First word of each document, and behind the last the number of all words.
        self.heads = np.searchsorted(self.starts, heads)

    def runs(self, shortest: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the runs of benchmark words, inside one document, that a window fits in."""
        known = (self.ids > 0).astype(np.int8)
        edge = np.zeros(len(known) + 1, bool)
        edge[1:-1] = known[1:] != known[:-1]
        edge[[0, -1]] = True
        edge[self.heads] = True
        cuts = np.flatnonzero(edge)
        begin, end = cuts[:-1], cuts[1:]
        good = (end - begin >= shortest) & (known[np.minimum(begin, len(known) - 1)] == 1)
        return begin[good], end[good]


def occurrences(shard: Shard, windows: Windows) -> Iterator[tuple[np.ndarray, int, list[list[str]], np.ndarray]]:
    """(first words, length, owners, which window) of everything found, for each window length."""
    begin, end = shard.runs(windows.shortest)
    if not len(begin):
        return
    sizes = end - begin
    ends = np.cumsum(sizes)
    where = np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)
    index = FMIndex(shard.ids[where], ends)
    for length, patterns in windows.patterns.items():
        low, high = index.search(patterns)
        count = high - low
        which = np.repeat(np.arange(len(patterns)), count)
        rows = np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)
        yield where[index.locate(rows)], length, windows.owners[length], which


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search_block(docs: DataFrame, items: list[tuple[str, bytes | None]], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        windows, names = Windows(sent.value, window), WordNames()
        flat = np.frombuffer(b" ".join(windows.words) or b" ", np.uint8)
        sizes = np.fromiter(map(len, windows.words), np.int64, len(windows.words))
        ends = np.cumsum(sizes + 1) - 1
        vocabulary = names(flat, ends - sizes, ends) if len(sizes) else np.zeros(1, np.uint64)
        order = np.argsort(vocabulary)
        vocabulary, numbers = vocabulary[order], order + 1 if len(sizes) else np.zeros(1, np.int64)
        out = Out(RESULT)

        def solve(ids: list, texts: list[bytes]) -> None:
            shard = Shard(texts, vocabulary, numbers, names)
            spans, owners = defaultdict(set), defaultdict(set)
            for first, length, lists, which in occurrences(shard, windows):
                doc = np.searchsorted(shard.heads, first, side="right") - 1
                for d, f, w in zip(doc.tolist(), (first - shard.heads[doc]).tolist(), which.tolist()):
                    spans[d].add((f, f + length))
                    owners[d].update(lists[w])
            for d, (key, text) in enumerate(zip(ids, texts)):
                out.add(key, int(shard.heads[d + 1] - shard.heads[d]), merged(spans.get(d, ())), sorted(owners.get(d, ()), key=id_order),
                        hashlib.md5(text).digest())

        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_py() or b""
                ids.append(key)
                texts.append(value)
                size += len(value) + 1
                if size >= SHARD_BYTES:
                    solve(ids, texts)
                    ids, texts, size = [], [], 0
                    if out.full():
                        yield out.take()
        solve(ids, texts)
        yield out.take()

    return docs.mapInArrow(search, RESULT_DDL)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs``.

    ``spans`` are the merged word ranges [first, behind last) that occur in the benchmark, ``items`` the ids (as
    strings) whose windows do; items without an id count, too, together as one null behind the others. Null and empty texts have no words; items without words are never found, and
    an item shorter than a window is one window. Items with equal text all count. Repeated rows of
    ``docs`` each get a row. Extra columns are not read.
    """
    return _found(docs, benchmark, window, block_bytes, id_col, text_col).drop("digest")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """As ``find_contamination``, with the MD5 of each text (of the empty text for null)."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), raw().alias("raw"))
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n_blocks = int(-(-size // block_bytes)) or 1
    placed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "raw"), F.lit(n_blocks)))
    parts = []
    for block in range(n_blocks):
        sent = [(r.item_id, r.raw and bytes(r.raw)) for r in placed.where(F.col("block") == block).collect()]
        parts.append(_search_block(source, sent, window))
    if n_blocks == 1:
        return parts[0]
    # Equal rows have equal results, so they are merged with their number and dealt out again.
    together = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "digest", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.flatten(F.collect_set("items"))).alias("items"),
        (F.count(F.lit(1)) / n_blocks).cast("int").alias("copies"))

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged({tuple(s) for s in found}) for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, RESULT.field("spans").type), batch.column(3), batch.column(4), batch.column(5)],
                ["doc_id", "n_words", "spans", "items", "digest", "copies"])

    return together.select("doc_id", "n_words", "spans", "items", "digest", "copies").mapInArrow(
        join_spans, "doc_id long, n_words long, spans array<array<long>>, items array<string>, digest binary, copies int"
    ).select("doc_id", "n_words", "spans", F.array_distinct("items").alias("items"), "digest", F.explode(F.sequence(F.lit(1), "copies")).alias("_i")).drop("_i")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold any window of the benchmark; rows are told apart by id and text, null ids too."""
    hit = _found(docs, benchmark, window, BLOCK_BYTES, "doc_id", "text").where("size(spans) > 0").select("doc_id", "digest").distinct()
    # Columns of the documents are one struct, so that none can clash.
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.unhex(F.md5(F.col("doc.text").cast("string"))) == F.col("digest"))
    return own.join(hit, same, "left_anti").select("doc.*")
