"""Quality rules judged per document and per host, with DataFrame functions only.

A document fails by itself on its own rules. Failures are summed by host; the failure rate of a host is shrunk with a
beta prior that is fitted to all hosts (moments of the beta-binomial), so a host of few documents says little. The
verdict of the host is joined back to its documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import SPACES, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def base_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in the struct ``doc``, and the measures of its text.

    Every step is row-local. Repeated windows are found by sorting the (64-bit) hashes of a text's windows with their
    positions, so long texts cost n log n; the hashes are only ever compared inside one text. Null counts as empty.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[text_col].cast("string").alias("_text"))
    counted = split.select(
        "doc", words(text).alias("w"), lines.alias("lines"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    hashed = counted.select(
        "doc", "word_chars", "n_symbols", F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""sort_array(if(size(w) > 3,
            transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS i)),
            CAST(array() AS array<struct<h: bigint, i: int>>)))""").alias("s"))
    repeated = hashed.withColumn("p", F.expr("""sort_array(transform(
        filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))"""))
    return repeated.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.expr("aggregate(transform(p, (x, j) -> coalesce(least(3, x - get(p, j - 1)), 3)), 0L, (a, b) -> a + b)")
        .alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class BetaPrior:
    """Failures that a host is credited with beforehand, and passes."""

    failed: float
    passed: float


def fit_prior(hosts: DataFrame) -> BetaPrior:
    """Moment fit of a beta-binomial to (n_docs, n_failed) of all hosts.

    Where the hosts tell nothing of how rates spread (one host, or the same rate all over), the prior is strong: a
    host then counts as like all others.
    """
    sums = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_docs").cast("double").alias("n"), F.sum("n_failed").cast("double").alias("f"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff")).first()
    if not sums.k:
        return BetaPrior(0.5, 0.5)
    mean = min(max(sums.f / sums.n, 1e-6), 1 - 1e-6)
    spread = sums.ff - sums.n * (sums.f / sums.n) ** 2
    room = mean * (1 - mean) * (sums.n - sums.nn / sums.n - (sums.k - 1))
    within = (spread - mean * (1 - mean) * (sums.k - 1)) / room if room > 0 else 0.0
    within = min(max(within, 1e-6), 1 - 1e-6)
    strength = (1 - within) / within
    return BetaPrior(mean * strength, (1 - mean) * strength)


def host_verdicts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, rejected) from rows of (host, base_failed); a null host is no host."""
    hosts = written(
        judged.where("host IS NOT NULL").groupBy("host").agg(
            F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed")), "hosts")
    prior = fit_prior(hosts)
    rate = (F.col("n_failed") + prior.failed) / (F.col("n_docs") + prior.failed + prior.passed)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > max_rate)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(doc_id, host, measures, base_failed, kept) of every row of ``docs``.

    ``kept`` is false if the document fails by itself or its host is rejected. Null and empty texts have no words
    and fail; a null host is never rejected; repeated rows are judged alike and each count for their host.
    """
    measured = base_features(docs, text_col).select(
        F.col(f"doc.{id_col}").alias("doc_id"), F.col(f"doc.{host_col}").cast("string").alias("host"), "n_words", "word_chars",
        "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = written(measured.withColumn("base_failed", base_failed()), "judged")
    bad = host_verdicts(judged, max_rate).where("rejected").select(F.col("host").alias("_bad"))
    return judged.join(bad, judged["host"] == bad["_bad"], "left").select(
        *judged.columns, (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; the text is read once."""
    judged = written(
        base_features(docs, text_col).select(
            "doc", F.col(f"doc.{host_col}").cast("string").alias("host"), base_failed().alias("base_failed")), "judged-docs")
    bad = host_verdicts(judged.select("host", "base_failed"), max_rate).where("rejected").select(F.col("host").alias("_bad"))
    good = judged.where("NOT base_failed")
    return good.join(bad, good["host"] == bad["_bad"], "left_anti").select("doc.*")
