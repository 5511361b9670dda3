"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import bpe, decontaminate, divergence, html_main, importance, line_dedup, quality_rules, secret_scan, simhash, substring_dedup, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def list_digest(values: Column, separator: str) -> Column:
    return F.sha2(F.concat_ws(separator, values.cast("array<string>")), 256)


@query("op1_quality_rules", """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, sum(least(3, coalesce(i - before, 3))) AS n_repeat FROM (
        SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM d) GROUP BY r),
m AS (SELECT r, doc_id, source, len(w)::BIGINT AS n_words, len(list_aggregate(w, 'string_agg', ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ff FROM h),
a AS (SELECT *, least(greatest(f / n, 1e-6), 1 - 1e-6) AS mean, ff - n * (f / n) * (f / n) AS spread FROM s),
c AS (SELECT *, mean * (1 - mean) * (n - nn / n - (k - 1)) AS room FROM a),
e AS (SELECT mean, least(greatest(CASE WHEN room > 0 THEN (spread - mean * (1 - mean) * (k - 1)) / room ELSE 0 END, 1e-6), 1 - 1e-6) AS within FROM c),
q AS (SELECT mean, (1 - within) / within AS strength FROM e),
bad AS (SELECT source FROM h, q WHERE (f + mean * strength) / (n + strength) > 0.5)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("host")


@query("op2_html_main_text")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return html_main.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


TOKEN_LIMIT = 4096


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.encode(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op4_substring_dedup", """
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM t, unnest(range(1, len(w) - 18)) AS u(i)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, rank() OVER (PARTITION BY g ORDER BY doc_id, i) AS place FROM g) WHERE place > 1),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM d, unnest(range(20)) AS u(k)),
p AS (SELECT doc_id, pos, w[pos] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(pos)),
k AS (SELECT p.doc_id, count(c.pos) AS n_removed, string_agg(word, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL) AS kept
      FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, folder, "documents"))


@query("op5_line_dedup", """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, i, string_split(text, chr(10))[i] AS line FROM t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
w AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS has_word FROM l),
n AS (SELECT source, count(*) AS total FROM t WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT r) AS pages FROM w WHERE has_word AND source IS NOT NULL GROUP BY ALL)
      JOIN n USING (source) WHERE pages >= 5 AND pages > 0.1::DOUBLE * total),
m AS (SELECT w.*, f.line IS NOT NULL AS gone FROM w LEFT JOIN f ON w.source = f.source AND w.line = f.line),
k AS (SELECT r, count_if(has_word) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
      FROM m GROUP BY r)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM t LEFT JOIN k USING (r)""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


@query("op6_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe.round_trip(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), list_digest(F.col("ids"), " ").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_toxicity")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_decontamination", """
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT r, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS g
      FROM t, (SELECT DISTINCT n FROM x) AS l, unnest(range(1, len(w) - l.n + 2)) AS u(i)),
m AS (SELECT r, i, d.n, item FROM d JOIN x ON d.n = x.n AND d.g = x.g),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(m.n)) AS u(k) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (r) LEFT JOIN o USING (r)""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        list_digest(F.array_sort("items"), ",").alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op9_secret_scan")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "word_pos", "kind", F.length("value").cast("long").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op11_suffix_dedup", """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc_id, 1000 * k AS base, substring(h, 2000 * k + 1, 2098) AS h FROM t, unnest(range(length(h) // 2000 + 1)) AS u(k)),
g AS (SELECT r, doc_id, base + i AS i, substring(h, 2 * i + 1, 100) AS g FROM c, unnest(range(least(1000, length(h) // 2 - 49))) AS u(i)),
f AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g),
d AS (SELECT r, i FROM g JOIN f USING (g) WHERE doc_id > owner),
e AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 50, true) AS opens FROM d),
n AS (SELECT r, i, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM e),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY r, span),
p AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM s),
k AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS b, string_agg(substring(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept
      FROM p JOIN t USING (r) GROUP BY r)
SELECT doc_id, length(h)::BIGINT // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN k USING (r)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, folder, "documents"))


@query("op12_importance")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_words")


@query("op13_divergence", """
WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM t) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n_lang FROM d GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM t),
c AS (SELECT lang, source, term, sum(n) AS n FROM d JOIN k USING (lang, term) GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_lang FROM g JOIN k USING (lang)
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY ALL),
p AS (SELECT a.lang, a.source, a.term, a.n, 1 + 1000000000::HUGEINT * (a.n + 2) // (s.total + 2 * v.v) AS p,
             1 + 1000000000::HUGEINT * (a.n_lang + 2) // (v.total + 2 * v.v) AS q
      FROM a JOIN s ON a.lang = s.lang AND a.source = s.source JOIN v ON a.lang = v.lang),
x AS (SELECT g.lang, g.source, o.source AS item FROM g JOIN g AS o ON g.lang = o.lang AND g.source <> o.source),
y AS (SELECT p.lang, p.source, o.source AS item, sum((p.p - o.p) * (p.p - o.p) // (p.p + o.p)) AS value
      FROM p JOIN p AS o ON p.lang = o.lang AND p.term = o.term AND p.source <> o.source GROUP BY ALL),
z AS (SELECT lang, source, 'pair' AS part, item, coalesce(y.value, 0) AS value FROM x LEFT JOIN y USING (lang, source, item)
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
n AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM n WHERE part = 'pair' OR rank <= 10""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
