"""How far the sources of a language differ in their words: partial counts by Arrow compute, divergences over columnar shards.

A task splits, encodes and groups its texts with Arrow's own kernels, from the buffers of its batches and by the numbers of their terms, and sends one
row for each (language, source, term) of a few megabytes. The merged counts of a language are dealt in shards of whole terms; a shard is a matrix of
counts, one column for each source, in which divergences are summed. Sources beyond ``SOURCES`` come in blocks, one shard for each pair of blocks. All numbers are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import written

MIN_DOCS = 10
TOP = 10
#: Letters: all bytes but those of ASCII that are no letters.
LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
#: Lower case, and a space for whatever is no letter.
PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if LETTER[b] else 32 for b in range(256))
BATCH_BYTES = 4 << 20
#: Cells (terms times sources) of a shard, and sources of a block, about.
CELLS = 1 << 18
SOURCES = 256
UNIT = 1_000_000_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
COUNTS_DDL = "lang string, source string, term string, n long, docs long"
PARTS_DDL = "lang string, source string, part string, item string, value long, terms long, p long, q long"


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bytes in pieces of about BATCH_BYTES, cut where no term can be."""
    at = 0
    while at < len(data):
        end = at + BATCH_BYTES
        while end < len(data):
            gaps = np.flatnonzero(~LETTER[data[end:end + BATCH_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += BATCH_BYTES
        yield at, min(end, len(data))
        at = end


def _terms(data: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, pa.DictionaryArray]:
    """(document, term) of some bytes, repeats included; documents meet at ``edges``."""
    texts = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(data.tobytes().translate(PLAIN)))
    split = pc.ascii_split_whitespace(texts)
    term = pc.list_flatten(split)
    real = pc.not_equal(term, "")
    return pc.list_parent_indices(split).filter(real).cast(pa.int64()), term.filter(real).dictionary_encode()


def _summed(key: pa.ChunkedArray, n: pa.ChunkedArray) -> pa.Table:
    """Each key once, the sum of its n and how often it is there."""
    return pa.table({"key": key, "n": n}).group_by("key", use_threads=False).aggregate([("n", "sum"), ("n", "count")])


def _paired(high: pa.Array, low: pa.Array, size: int) -> pa.Array:
    """Two whole numbers, of which the lower is below ``size``, as one."""
    return pc.add(pc.multiply(high, size), low)


def _counted(docs: pa.Table) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents; each group has a row without a term, too.

    Terms are encoded once; all else is grouped by whole numbers, since strings take far longer to group.
    """
    langs, sources = (docs[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
    width = len(sources.dictionary)
    groups = _paired(langs.indices.cast(pa.int64()), sources.indices.cast(pa.int64()), width).dictionary_encode()
    group, n_groups = groups.indices.cast(pa.int64()), len(groups.dictionary)

    texts = docs["text"].combine_chunks()
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
    edges = edges - edges[0]
    names, keys, counts, known = [], [], [], 0
    for at, end in _pieces(data):
        doc, coded = _terms(data[at:end], np.clip(edges, at, end) - at)
        key = _paired(pc.add(coded.indices.cast(pa.int64()), known), doc, len(docs))
        found = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")])
        names.append(coded.dictionary)
        keys.append(found["key"])
        counts.append(found["count_all"])
        known += len(coded.dictionary)
    terms = pa.chunked_array(names, pa.large_string()).combine_chunks()
    key, n = (pa.chunked_array([c for x in lists for c in x.chunks], pa.int64()) for lists in (keys, counts))
    code = pc.divide(key, len(docs))
    doc = pc.subtract(key, pc.multiply(code, len(docs)))
    if len(names) > 1:
        # Pieces have numbers of their own for their terms.
        again = terms.dictionary_encode()
        terms = again.dictionary
        whole = _summed(_paired(pc.take(again.indices, code).cast(pa.int64()), doc, len(docs)), n)
        n, code = whole["n_sum"], pc.divide(whole["key"], len(docs))
        doc = pc.subtract(whole["key"], pc.multiply(code, len(docs)))
    found = _summed(_paired(code, pc.take(group, doc), n_groups), n)
    code = pc.divide(found["key"], n_groups)
    member = pc.take(groups.dictionary, pc.subtract(found["key"], pc.multiply(code, n_groups)))

    def rows(member: pa.ChunkedArray, *others) -> pa.Table:
        lang = pc.divide(member, width)
        source = pc.subtract(member, pc.multiply(lang, width))
        return pa.table([pc.take(langs.dictionary, lang), pc.take(sources.dictionary, source), *others], names=COUNTS.names).cast(COUNTS)

    none = pa.array(np.zeros(n_groups, np.int64))
    every = rows(groups.dictionary, pa.nulls(n_groups, pa.string()), none, none)
    return pa.concat_tables([rows(member, pc.take(terms, code), found["n_sum"], found["n_count"]), every]).combine_chunks().to_batches()[0]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Table, int]]:
    """Runs of rows with about BATCH_BYTES of text, or one row with more, and their size; a row counts 64 besides."""
    table = pa.table([c.cast(pa.large_string()) for c in batch.columns], names=["text", "lang", "source"])
    size = np.cumsum(pc.binary_length(table["text"]).to_numpy() + 64)
    at, before = 0, 0
    while at < len(size):
        end = min(int(np.searchsorted(size, before + BATCH_BYTES)) + 1, len(size))
        yield table.slice(at, end - at), int(size[end - 1]) - before
        at, before = end, int(size[end - 1])


def partial_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), summed over a few megabytes of (text, lang, source) each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for rows, more in _slices(batch):
                held.append(rows)
                size += more
                if size >= BATCH_BYTES:
                    yield _counted(pa.concat_tables(held))
                    held, size = [], 0
        if held:
            yield _counted(pa.concat_tables(held))

    return docs.mapInArrow(run, COUNTS_DDL)


def share(count: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / total), by long division in base 1000 so that nothing overflows below 9 * 10^15."""
    rest = np.asarray(count, np.int64) + 2
    out = rest // total
    rest = rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shard(found: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """Sums over the terms of one shard for each pair of its sources, and for each source the terms it stands out by."""
    out = []
    lang, one = groups["lang"].iat[0], groups["block_a"].iat[0] == groups["block_b"].iat[0]
    terms, row = np.unique(found["term"].to_numpy(object), return_inverse=True)

    def shares(side: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sources, counts and shares (sources by terms), and the share of a term that a source lacks."""
        members = groups[groups["side"] == side].sort_values("source")
        here = (found["side"] == side).to_numpy()
        counts = np.zeros((len(members), len(terms)), np.int64)
        place = {s: i for i, s in enumerate(members["source"])}
        counts[[place[s] for s in found["source"][here]], row[here]] = found["n"][here]
        total = np.maximum((members["total"] + 2 * members["vocabulary"]).to_numpy(np.int64), 1)
        return list(place), counts, share(counts, total[:, None]), share(np.zeros(len(total), np.int64), total)

    names, counts, p, zero_p = shares(0)
    others, _, q, zero_q = (names, counts, p, zero_p) if one else shares(1)
    for i, name in enumerate(names):
        sums = gap(p[i], q).sum(axis=1)
        out += [(lang, name, "pair", other, int(sums[j]), len(terms), int(zero_p[i]), int(zero_q[j]))
                for j, other in enumerate(others) if not one or i < j]
    if one and len(terms):
        n_lang = np.empty(len(terms), np.int64)
        n_lang[row] = found["n_lang"]
        everywhere = share(n_lang, int(groups["lang_total"].iat[0] + 2 * groups["vocabulary"].iat[0]))
        for i, name in enumerate(names):
            good = np.flatnonzero((counts[i] > 0) & (p[i] > everywhere))
            value = gap(p[i][good], everywhere[good])
            # Terms are in the order of their characters, which is that of their UTF-8 bytes.
            for k in np.lexsort((good, -value))[:top].tolist():
                out.append((lang, name, "term", terms[good[k]], int(value[k]), 0, 0, 0))
    return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value", "terms", "p", "q"])


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank), ranks from 1 for each group and part.

    Part ``pair``: the divergence of a source from each other source of its language, summed over all kept terms. Part ``term``: the ``top``
    terms by which a source stands out from its language. A term is kept if at least ``min_docs`` rows of its language have it.
    Null texts, languages and sources are empty strings; a source without terms is a source like any other; repeated rows count each;
    ties go to the smaller item. A language with one source has no pairs, an empty table no rows. Extra columns are not read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = written(partial_counts(texts).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = written(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    used = written(counts.where("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]), "used-terms")

    zero = F.lit(0).cast("long")
    langs = counts.where("term IS NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        kept.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n_lang").alias("lang_total")), "lang", "left").select(
        "lang", "sources", F.coalesce("vocabulary", zero).alias("vocabulary"), F.coalesce("lang_total", zero).alias("lang_total"))
    langs = langs.withColumn("blocks", F.ceil(F.col("sources") / SOURCES).cast("int")).withColumn(
        "shards", F.ceil((F.col("vocabulary") * F.least("sources", F.lit(SOURCES)) + 1) / CELLS).cast("int"))
    langs = written(langs, "languages")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = written(counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang").select(
        "lang", "source", F.coalesce("total", zero).alias("total"), "vocabulary", "lang_total", "blocks", "shards"), "groups")

    def placed(rows: DataFrame, shard: Column) -> DataFrame:
        """Each row in all pairs of blocks that its source is in: as the first (side 0) or the second of them (1)."""
        block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
        as_first = F.transform(F.sequence(F.col("block"), F.col("blocks") - 1), lambda b: F.struct(F.col("block").alias("a"), b.alias("b"), F.lit(0).alias("side")))
        as_second = F.transform(F.filter(F.sequence(F.lit(0), F.col("block")), lambda a: a < F.col("block")),
                                lambda a: F.struct(a.alias("a"), F.col("block").alias("b"), F.lit(1).alias("side")))
        return rows.withColumn("shard", shard).withColumn("block", block).withColumn("at", F.explode(F.concat(as_first, as_second))).withColumns(
            {"block_a": F.col("at.a"), "block_b": F.col("at.b"), "side": F.col("at.side")}).drop("block", "at", "blocks", "shards")

    spread = placed(used.join(langs.select("lang", "blocks", "shards"), "lang"), F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    sides = placed(groups, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    key = ["lang", "shard", "block_a", "block_b"]

    def solve(found: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        return _shard(found, here, top)

    parts = written(spread.groupBy(*key).cogroup(sides.groupBy(*key)).applyInPandas(solve, PARTS_DDL), "shard-sums")
    return _ranked(parts, groups, top)


def _ranked(parts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Shards of a pair added up, with the terms that none of its two sources has, then both directions, then ranks."""
    summed = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("p").alias("p"), F.max("q").alias("q"))
    langs = groups.groupBy("lang").agg(F.max("vocabulary").alias("vocabulary"))
    whole = summed.join(langs, "lang").withColumn("value", F.expr("value + (vocabulary - terms) * ((p - q) * (p - q) div (p + q))")).select(
        "lang", "source", "item", "value")
    both = whole.unionByName(whole.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
