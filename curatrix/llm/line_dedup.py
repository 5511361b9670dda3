"""Boilerplate lines by their frequency inside one site.

Per host, the pages that contain a line are divided by all pages of the host; lines above a ratio are
menus, notices or footers and go. What is kept for a host is short by definition: at a ratio r there are at most
(lines of an average page) / r such lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import written

MAX_RATIO = 0.1
MIN_PAGES = 5


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_key(line: Column) -> Column:
    """16 bytes that stand for the whole line."""
    return F.unhex(F.md5(line))


def boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES, copies_count: bool = True) -> DataFrame:
    """(host, keys): the lines of each host that are on more than ``max_ratio`` of its pages and on at least ``min_pages``.

    A page counts once however often it has the line. Blank lines and pages without a host are left out. Counts are
    summed before the shuffle, so a line that every page has is one row of each task. Without ``copies_count`` pages of one host
    with equal text are one page, in the host's total too: a document is no boilerplate because it was copied.
    """
    pages = docs.where(F.col(host_col).isNotNull()).select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    keys = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), has_word), line_key))
    pages = pages.select("host", F.md5("text").alias("digest"), keys.alias("lines"))
    if not copies_count:
        pages = written(pages.groupBy("host", "digest").agg(F.first("lines").alias("lines")), "distinct-pages")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    counted = pages.select("host", F.explode("lines").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    frequent = counted.where(F.col("pages") >= min_pages)
    return frequent.join(totals, "host").where(F.col("pages") > max_ratio * F.col("total")).groupBy("host").agg(
        F.collect_list("key").alias("keys"))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, copies_count: bool = True) -> DataFrame:
    """(doc, n_lines, n_dropped): ``doc`` has the columns of ``docs``, its text without the boilerplate of its host.

    The other lines and blank lines stay as they are. ``n_lines`` counts lines with a word. Null texts stay null and have no lines; a
    document of nothing but boilerplate keeps an empty text. Repeated rows are cleaned alike and count as pages each,
    or as one without ``copies_count``.
    """
    found = written(boilerplate(docs, text_col, host_col, max_ratio, min_pages, copies_count), "boilerplate")
    text = F.col(f"doc.{text_col}").cast("string")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[host_col].cast("string").alias("_host"))
    joined = rows.join(found, rows["_host"] == found["host"], "left").select("doc", "keys", F.split(text, "\n").alias("lines"))
    dropped = F.coalesce(F.size(F.filter("lines", lambda s: F.array_contains(F.col("keys"), line_key(s)))), F.lit(0))
    marked = joined.select(
        "doc", F.coalesce(F.size(F.filter("lines", has_word)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("keys").isNotNull() & F.col("lines").isNotNull(), dropped).otherwise(0).cast("long").alias("n_dropped"),
        F.when(F.col("keys").isNotNull(), F.array_join(F.filter("lines", lambda s: ~F.array_contains(F.col("keys"), line_key(s))), "\n"))
        .otherwise(text).alias("_kept"))
    return marked.select(F.col("doc").withField(text_col, F.col("_kept")).alias("doc"), "n_lines", "n_dropped")
