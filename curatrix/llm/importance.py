"""Importance resampling towards a target distribution, over hashed runs of words.

An untrained Split of the tokenizers library cuts ASCII-lowered text into words with offsets. Windows of one to three words are pairs of offsets (begin of
the first, end of the last) into the words joined by one space; their CRC-32 comes from the CRCs of the text before the two
offsets, so no window is ever copied. A task writes the bucket of each window once; histograms, gains and sums are taken
from those numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from curatrix.llm.common import ASCII_LOWER, raw, written

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
#: The share of documents that is drawn, in hundredths.
PERCENT = 5
SEED = 42
#: Everything that is in no word: ASCII but digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of one text that are cut into words at a time, and words whose windows are hashed together.
PIECE_BYTES = 256 << 10
WORDS = 1 << 16

FEATURES_DDL = "doc_id long, n_words long, buckets binary"


# --- CRC-32 of windows ---------------------------------------------------------

def _shifters(levels: int = 40) -> list[np.ndarray]:
    """Tables that append 2^k zero bytes to a CRC-32 (without its first and last inversion): four of 256 entries each."""
    def table(act) -> np.ndarray:
        basis = [act(1 << b) for b in range(32)]
        out = np.zeros((4, 256), np.uint32)
        for part in range(4):
            for b in range(8):
                out[part][np.arange(256) >> b & 1 == 1] ^= np.uint32(basis[8 * part + b])
        return out

    def one_byte(value: int) -> int:
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    tables = [table(one_byte)]
    while len(tables) < levels:
        last = tables[-1]
        tables.append(table(lambda value, t=last: int(_apply(t, _apply(t, np.array([value], np.uint32)))[0])))
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


SHIFT = _shifters()


def append_zeros(crc: np.ndarray, count: np.ndarray) -> np.ndarray:
    """CRCs after ``count`` more zero bytes, without inversions."""
    out = crc.copy()
    for k in range(int(count.max()).bit_length() if len(count) else 0):
        some = np.flatnonzero(count >> k & 1)
        out[some] = _apply(SHIFT[k], out[some])
    return out


def window_crcs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of the words joined by one space: before each word and behind it, with the offsets of both (begins, then ends)."""
    crc, before, behind = 0, np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    step = zlib.crc32
    for i, word in enumerate(words):
        before[i] = crc
        crc = step(word, crc)
        behind[i] = crc
        crc = step(b" ", crc)
    return before, behind, np.stack([ends - sizes, ends])


def window_buckets(words: list[bytes], owner: np.ndarray, fresh: np.ndarray, longest: int = LONGEST,
                   buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of each window of 1 to ``longest`` words that ends in a ``fresh`` word and does not leave its document."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.uint16)
    before, behind, offsets = window_crcs(words)
    owners, found = [], []
    for k in range(min(longest, len(words))):
        last = np.flatnonzero(fresh[k:] & (owner[k:] == owner[:len(owner) - k])) + k
        first = last - k
        # The CRC of a text is that of its beginning, moved over the rest, xor that of the rest.
        crc = behind[last] ^ append_zeros(before[first], offsets[1][last] - offsets[0][first])
        owners.append(owner[last])
        found.append((crc % np.uint32(buckets)).astype(np.uint16))
    return np.concatenate(owners), np.concatenate(found)


# --- features of documents -------------------------------------------------------

def _pieces(text: bytes) -> Iterator[str]:
    """Lowered text in pieces, each cut where no word can be."""
    low, at = text.translate(ASCII_LOWER), 0
    while at < len(low):
        end = min(at + PIECE_BYTES, len(low))
        while end < len(low):
            outside = np.flatnonzero(~IN_WORD[np.frombuffer(low, np.uint8, min(PIECE_BYTES, len(low) - end), end)])
            end += int(outside[0]) if len(outside) else min(PIECE_BYTES, len(low) - end)
            if len(outside):
                break
        yield low[at:end].decode("utf-8", "surrogateescape")
        at = end


def features(docs: DataFrame, id_col: str, text_col: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets) of every row: the bucket of each window in two bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        rows: list[list] = []
        words, owner, fresh = [], [], []

        def hashed() -> None:
            """Windows of the words at hand go to their rows; the last words stay for windows that begin in them."""
            nonlocal words, owner, fresh
            who, found = window_buckets(words, np.array(owner, np.int64), np.array(fresh, bool), longest, buckets)
            order = np.argsort(who, kind="stable")
            who, found = who[order], found[order]
            edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.empty(0, np.int64)
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(who)]):
                rows[who[a]][2].append(found[a:b].tobytes())
            keep = longest - 1
            words, owner, fresh = words[-keep:], owner[-keep:], [False] * min(keep, len(words))

        def taken() -> pa.RecordBatch:
            nonlocal rows, words, owner, fresh
            hashed()
            batch = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([b"".join(r[2]) for r in rows], pa.binary())], ["doc_id", "n_words", "buckets"])
            rows, words, owner, fresh = [], [], [], []
            return batch

        total = 0
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                rows.append([key.as_py(), 0, []])
                for piece in _pieces(text.as_py() or b""):
                    here = [w.encode("utf-8", "surrogateescape") for w, _ in cut.pre_tokenize_str(piece)]
                    words += here
                    owner += [len(rows) - 1] * len(here)
                    fresh += [True] * len(here)
                    rows[-1][1] += len(here)
                    total += len(here)
                    if len(words) >= WORDS:
                        hashed()
                if total >= 16 * WORDS or len(rows) >= 10_000:
                    yield taken()
                    total = 0
        yield taken()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), raw(text_col).alias("raw")).mapInArrow(run, FEATURES_DDL)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket, over all rows; a task sends at most ``buckets`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer() or b"", np.uint16), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) of each bucket, both with one added."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the gains of a document's features added up."""
    sent = found.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(v.as_buffer(), np.uint16) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in lists], pa.int64()),
                 pa.array([int(sent.value[x].sum()) for x in lists], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


# --- the draw ----------------------------------------------------------------------

def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the drawn share of rows with enough words, by score, then by id; null for the others.

    Rows are dealt by ranges of the order and sorted where they are. A row's place is its place in its range, which needs no other range,
    and the sizes of the ranges before: one number for each range.
    """
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    able = F.col("n_words") >= min_words
    sorted_rows = scored.withColumn("able", able).repartitionByRange(*order).sortWithinPartitions(*order)
    # The id has the number of the partition in its upper 31 bits and that of the row in the lower 33.
    at = F.monotonically_increasing_id()
    placed = written(sorted_rows.withColumn("at", at).withColumns({"range": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "placed")
    sizes = {r["range"]: r.n for r in placed.where("able").groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    offsets = scored.sparkSession.createDataFrame([*before.items()] or [(-1, 0)], "range long, before long")
    rank = F.col("before") + F.col("row") + 1
    return placed.join(F.broadcast(offsets), "range", "left").withColumn("rank", F.when(F.col("able") & (rank <= percent * total // 100), rank)).drop(
        "able", "at", "range", "row", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where a row is not drawn.

    Null and empty texts have no words: weight 0, never drawn. The noise of a row comes from its id, so repeated rows tie, and then stand one
    behind the other; a null id counts as the text ``null`` and comes last among ties. An empty target or an empty table of documents is a
    histogram of zeros. Extra columns are not read.
    """
    found = written(features(docs, id_col, text_col), "features")
    corpus = histogram(found)
    wanted = histogram(features(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(found, gains(corpus, wanted)).withColumn("score", F.col("weight") + noise)
    return ranked(scored, percent, min_words).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
