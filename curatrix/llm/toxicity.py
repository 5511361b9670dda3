"""Toxicity of texts that may be disguised: noisy-channel decoding, then a score of the restored text.

A character language model is counted over all documents. Stretches that look disguised (digits and signs among
letters, letters set apart, letters repeated) become lattices of what each sign may stand for; Viterbi finds
the reading that the language model and the channel like best. Everything else has one reading only and stays. The
classifier learns words and stems of restored texts from labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import raw, written

# Fixed values of the channel: what a sign may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
    "|": "li", "+": "t", "€": "e", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
INNER = "".join(re.escape(c) for c in LEET)
GAPS = r" .\-_*\u200b\u200c\u200d"

LETTER = r"[^\W\d_]"
CHAR = r"[\w@$!|+€]"
ZERO_WIDTH = "\u200b\u200c\u200d"
LETTER = r"[^\W\d_]"
CHAR = r"[\w@$!|+€]"
# Stretches with more than one reading; nothing else is decoded: single letters set apart, words with signs among or
# beside their letters, words with a letter three times in a row or with invisible breaks.
SPACED = re.compile(rf"(?<!\w)(?:{LETTER}|[{INNER}])(?:[{GAPS}](?:{LETTER}|[{INNER}])(?!\w)){{3,}}")
SIGNED = re.compile(
    rf"(?<!{CHAR})(?={CHAR}*?{LETTER}[{INNER}]+{LETTER}|[{INNER}]{{1,2}}{LETTER}|{LETTER}+[0-9@$+](?!{CHAR})){CHAR}+")
REPEATED = re.compile(rf"\w*({LETTER})\1\1\w*|\w+[{ZERO_WIDTH}]\w+")

#: Classes of code points, to tell which of the three a text can have at all; the last stands for all beyond.
PLAIN = 0x250
IS_LETTER, IS_SIGN, IS_GAP = (
    np.array([bool(test(chr(i))) for i in range(PLAIN)] + [True])
    for test in (str.isalpha, LEET.__contains__, lambda c: c in " .-_*"))


def disguises(text: str) -> list[re.Pattern]:
    """The patterns that may match in a text."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) < 3:
        return []
    if points.max() >= PLAIN:
        return [SPACED, SIGNED, REPEATED]
    letter, sign, gap = IS_LETTER[points], IS_SIGN[points], IS_GAP[points]
    found = []
    if (gap[:-2] & gap[2:] & ~gap[1:-1]).any():
        found.append(SPACED)
    if sign.any() and ((sign[:-1] & letter[1:]).any() or (letter[:-1] & sign[1:]).any()):
        found.append(SIGNED)
    same = points[1:] == points[:-1]
    if (same[1:] & same[:-1] & letter[2:]).any():
        found.append(REPEATED)
    return found


#: Symbols of the language model: boundary, a to z, any byte beyond ASCII, digits.
N_SYMBOLS = 29
SYMBOL = np.zeros(256, np.int64)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[128:] = 27
SYMBOL[48:58] = 28
COST_LEET, COST_SIGN, COST_DROP_REPEAT, COST_KEEP_GAP, COST_DROP_GAP = 0.5, 4.0, 0.5, 8.0, 0.2

COUNT_BYTES = 4 << 20
SAMPLE_ROWS = 30_000
MAX_FEATURES = 4096
MIN_SUPPORT = 4
STEMS = (4, 5, 6, 7)
COVER = 3
REMEMBERED = 100_000
ROUNDS = 1500


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(trigram, n) over all texts, summed in each task before the shuffle; there are at most 29^3 trigrams."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS ** 3, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for i in range(0, len(text or b""), COUNT_BYTES):
                    piece = np.frombuffer(b"  " + text[max(0, i - 2):i + COUNT_BYTES] + b" " if not i else text[i - 2:i + COUNT_BYTES], np.uint8)
                    code = SYMBOL[piece]
                    total += np.bincount((code[:-2] * N_SYMBOLS + code[1:-1]) * N_SYMBOLS + code[2:], minlength=N_SYMBOLS ** 3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["trigram", "n"])

    return docs.select(raw(text_col).alias("raw")).mapInArrow(count, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative logarithms) of a symbol after two others, smoothed with bigrams."""
    table = np.zeros(N_SYMBOLS ** 3)
    for row in counts.collect():  # at most 29^3 rows
        table[row.trigram] = row.n
    table = table.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
    pairs = table.sum(axis=0)
    single = pairs.sum(axis=0) + 1.0
    second = (pairs + 5.0 * single / single.sum()) / (pairs.sum(axis=1, keepdims=True) + 5.0)
    third = (table + 20.0 * second[None]) / (table.sum(axis=2, keepdims=True) + 20.0)
    return -np.log(third)


def symbol_of(char: str) -> int:
    return int(SYMBOL[ord(char)]) if ord(char) < 128 else 27 if char.isalpha() else 0


@dataclass
class Decoder:
    """Viterbi over the character lattice of a disguised stretch."""

    costs: list = field(default_factory=list)
    known: dict[str, str] = field(default_factory=dict)

    def options(self, stretch: str) -> list[list[tuple[str, float]]]:
        """For each sign what it may be read as, and what that costs; an empty reading drops it."""
        lattice = []
        spaced = len(stretch) > 4 and all(c in " .-_*\u200b\u200c\u200d" for c in stretch[1::2])
        for i, char in enumerate(stretch):
            if spaced and i % 2:
                lattice.append([("", COST_DROP_GAP), (" ", COST_KEEP_GAP)])
            elif char in "\u200b\u200c\u200d":
                lattice.append([("", 0.0)])
            else:
                ways = [(char, COST_SIGN if char in LEET else 0.0)]
                ways += [(c, COST_LEET) for c in LEET.get(char, "")]
                step = 2 if spaced else 1
                if i >= step and char == stretch[i - step] and char in (stretch[i - 2 * step:i - step] + stretch[i + step:i + step + 1]):
                    ways.append(("", COST_DROP_REPEAT))
                lattice.append(ways)
        return lattice

    def best(self, stretch: str) -> str:
        found = self.known.get(stretch)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[stretch] = self._viterbi(stretch)
        return found

    def _viterbi(self, stretch: str) -> str:
        costs = self.costs
        # A state is the last two symbols; back-pointers are shared chains, so memory grows with the length only.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for ways in self.options(stretch):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for char, price in ways:
                    if char:
                        c = symbol_of(char)
                        key, total, chain = (b, c), cost + price + costs[a][b][c], (path, char)
                    else:
                        key, total, chain = (a, b), cost + price, path
                    old = after.get(key)
                    if old is None or total < old[0]:
                        after[key] = (total, chain)
            states = after
        _, path = min(((cost + costs[a][b][0], path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            path, char = path
            out.append(char)
        return "".join(reversed(out))

    def restore(self, text: str) -> str:
        """The text in lower case, with its disguised stretches read."""
        text = text.lower()
        for pattern in disguises(text):
            text = pattern.sub(lambda m: self.best(m.group()), text)
        return text


WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """Words of a restored text, and the stems that they begin with."""
    found = set(WORD.findall(text))
    stems = {w[:n] + "*" for w in found for n in STEMS if len(w) > n}
    return found | stems


@dataclass
class Model:
    """Weights of features, of having any of them, and the bias."""

    weights: dict[str, float]
    any_weight: float
    bias: float
    costs: np.ndarray

    def scorer(self):
        """A function from text to probability."""
        decoder = Decoder(self.costs.tolist())
        words = {k: v for k, v in self.weights.items() if not k.endswith("*")}
        stems = {n: {k[:-1]: v for k, v in self.weights.items() if k.endswith("*") and len(k) == n + 1} for n in STEMS}

        def score(text: str | None) -> float:
            found = set(WORD.findall(decoder.restore(text or "")))
            hits = [words[w] for w in found & words.keys()]
            for n, known in stems.items():
                if known:
                    hits += [known[s] for s in {w[:n] for w in found if len(w) > n} & known.keys()]
            total = self.bias + (self.any_weight + sum(hits) if hits else 0.0)
            return 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))

        return score


def held_out(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, costs: np.ndarray, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Model:
    """Logistic regression on words and stems of at most ``sample_rows`` labelled documents, held-out ones left out.

    The sample is the rows with the smallest hashes of their ids. Of the features that mark class 1 more often than
    not, the strongest are candidates, and those that add to each other's cover take part. Without labels of
    both classes the score is their share, 0.5 without any.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()
    positive = sum(r.toxic for r in sample)
    rate = (positive + 1) / (len(sample) + 2)
    if not positive or positive == len(sample):
        return Model({}, 0.0, log(rate / (1 - rate)), costs)
    # At most ``sample_rows`` pairs of numbers, so the broadcast is bounded.
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in sample], "doc_id long, toxic int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    sent = spark.sparkContext.broadcast(costs)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value.tolist())
        for batch in batches:
            made = [sorted(features(decoder.restore(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.string()))], ["doc_id", "toxic", "features"])

    held = written(texts.select("doc_id", "text", "toxic").mapInArrow(take, "doc_id long, toxic int, features array<string>"), "toxic-sample")
    n_pos, n_neg = positive, len(sample) - positive
    counted = held.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    gain = F.col("p") * F.log((F.col("p") + 0.5) / n_pos * n_neg / (F.col("q") + 0.5))
    strong = counted.where((F.col("p") >= MIN_SUPPORT) & (F.col("p") > F.col("q"))).orderBy(gain.desc(), "feature").limit(max_features)
    names = [r.feature for r in strong.collect()]
    wanted = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    rows = held.select("toxic", F.array_intersect("features", wanted).alias("f")).groupBy("toxic", "f").agg(F.count(F.lit(1)).alias("n")).collect()
    at = {n: i for i, n in enumerate(names)}
    row = np.repeat(np.arange(len(rows)), [len(r.f) for r in rows])
    col = np.array([at[f] for r in rows for f in r.f], np.int64)
    y, n = np.array([r.toxic for r in rows], float), np.array([r.n for r in rows], float)
    chosen_cols = _cover(names, row, col, y, n)
    number = np.full(len(names), -1)
    number[chosen_cols] = np.arange(len(chosen_cols))
    used = number[col] >= 0
    row, col = row[used], number[col[used]]
    # The last feature says that any of the others is there.
    marked = np.unique(row)
    row, col = np.append(row, marked), np.append(col, np.full(len(marked), len(chosen_cols)))
    weights, bias = _logistic(row, col, y, n, len(chosen_cols) + 1, log(rate / (1 - rate)))
    return Model({names[c]: float(w) for c, w in zip(chosen_cols, weights)}, float(weights[-1]), bias, costs)


def _cover(names: list[str], row: np.ndarray, col: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[int]:
    """Features that each mark toxic documents which fewer than COVER others mark.

    Near copies of one toxic document share all their words; taking features by what they add keeps such words out.
    """
    left, picked = np.full(len(y), COVER), []
    free = np.ones(len(names), bool)
    least = max(3.0, 0.005 * (y * n).sum())
    worth = np.where(y == 1, n, -n)
    length = np.array([len(x) for x in names])
    while True:
        gain = np.bincount(col, (worth * (left > 0))[row], len(names)) * free
        if not len(gain) or gain.max() < least:
            return picked
        top = np.flatnonzero(gain == gain.max())
        best = int(top[np.argmax(length[top])])
        picked.append(best)
        free[best] = False
        left[row[col == best]] -= 1


def _logistic(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: np.ndarray, size: int, bias: float) -> tuple[np.ndarray, float]:
    weights = np.zeros(size)
    m1, m2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, ROUNDS + 1):
        score = bias + np.bincount(row, weights[col], len(y))
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * n / n.sum()
        slope = np.append(np.bincount(col, error[row], size) + 1e-5 * weights, error.sum())
        m1, m2 = 0.9 * m1 + 0.1 * slope, 0.999 * m2 + 0.001 * slope ** 2
        move = 0.1 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Only the text is scored. Null and empty texts get the score of a text without words. Repeated rows each get a row
    with equal values; for a repeated label the larger one counts. A null id is not held out. Extra columns are not read.
    """
    costs = language_model(trigram_counts(docs))
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, costs, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            made = [float(scorer(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
