"""The audit views of ``curatrix.sources.tables`` in ANSI SQL, as common table expressions."""

ITEMS = r"""
items AS (
  SELECT doc_id AS item_id,
         CASE WHEN doc_id % 10 < 7 THEN 'Train' WHEN doc_id % 10 < 9 THEN 'Validation' ELSE 'Test' END AS split,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 2 = 0 THEN 'Fake' ELSE 'Real' END AS class,
         doc_id // 10 AS stem, md5(text) AS content_md5, n_chars AS file_size, text
  FROM documents),
pathed AS (
  SELECT *, '/store/Real/v1/' || split || '/' || class || '/item_' || stem || '.txt' AS path FROM items)
"""

TOKENS = r"""
toks AS (
  SELECT item_id, split, class, content_md5, file_size, text,
         list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS tokens
  FROM items)
"""

METRICS = TOKENS + r""",
raw_metrics AS (
  SELECT item_id, split, class, content_md5 AS file_hash, CAST(octet_length(encode(text)) AS BIGINT) AS file_size,
         coalesce(len(tokens), 0) = 0 AS is_corrupt,
         CASE WHEN len(tokens) > 0 THEN list_max(list_transform(string_split(text, chr(10)), lambda s: length(s))) END AS width,
         CASE WHEN len(tokens) > 0 THEN len(string_split(text, chr(10))) END AS height,
         CASE WHEN len(tokens) > 0 THEN round(255.0::DOUBLE * length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text), 6) END AS brightness,
         CASE WHEN len(tokens) > 0 THEN CAST(len(list_distinct(tokens)) AS DOUBLE) END AS blur_score,
         CASE WHEN len(tokens) > 0 THEN round(sqrt(
            list_sum(list_transform(tokens, lambda t: length(t) * length(t)))::DOUBLE / len(tokens)
            - (list_sum(list_transform(tokens, lambda t: length(t)))::DOUBLE / len(tokens))
            * (list_sum(list_transform(tokens, lambda t: length(t)))::DOUBLE / len(tokens))), 6) END AS pixel_std
  FROM toks),
metrics AS (
  SELECT item_id, split, class, file_hash, file_size, CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height,
         width::DOUBLE / height AS aspect_ratio, brightness, blur_score, pixel_std,
         coalesce(width < 64 OR height < 64, false) AS is_low_res,
         coalesce(blur_score < 50, false) AS is_blurry,
         coalesce(pixel_std < 1.0, false) AS is_blank,
         coalesce(brightness < 30, false) AS is_dark,
         coalesce(brightness > 225, false) AS is_bright,
         coalesce(abs(width::DOUBLE / height - 1.0) > 0.05, false) AS is_non_square,
         is_corrupt, CASE WHEN is_corrupt THEN 'unreadable' END AS error
  FROM raw_metrics)
"""

FINGERPRINTS = TOKENS + r""",
words AS (SELECT item_id, unnest(list_distinct(tokens)) AS token FROM toks),
hashed AS (SELECT item_id, CAST('0x' || substr(md5(token), 1, 16) AS UBIGINT) AS h FROM words),
votes AS (
  SELECT item_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS vote
  FROM hashed, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS b) GROUP BY item_id, b),
fp_only AS (
  SELECT item_id, CAST(sum(CASE WHEN vote > 0 THEN CAST(1 AS HUGEINT) << b::HUGEINT ELSE 0 END) AS UBIGINT) AS fp
  FROM votes GROUP BY item_id),
fps AS (SELECT i.item_id, i.split, i.class, i.content_md5, f.fp FROM items i JOIN fp_only f USING (item_id))
"""

PAIRS = FINGERPRINTS + r""",
pairs AS (
  SELECT a.item_id AS id_a, b.item_id AS id_b, CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance,
         a.fp AS fp_a, b.fp AS fp_b, a.split AS split_a, b.split AS split_b, a.class AS class_a, b.class AS class_b
  FROM fps a JOIN fps b ON a.item_id < b.item_id AND bit_count(xor(a.fp, b.fp)) <= 5)
"""

PREDICTIONS = TOKENS + r""",
scored AS (
  SELECT item_id, split, class,
         round(1.0::DOUBLE - len(list_distinct(tokens))::DOUBLE / len(tokens), 6) AS p_base,
         round(least(1.0::DOUBLE, 4.0::DOUBLE * (length(text) - length(regexp_replace(text, '[^\p{L}\s]', '', 'g'))) / length(text)), 6) AS p_hn
  FROM toks),
ensembled AS (
  SELECT s.*, l.toxic AS label, 1 - l.quality AS label_q, greatest(l.toxic, 1 - l.quality) AS label_any, (p_base + p_hn) / 2 AS p_ens
  FROM scored s JOIN labels l ON l.doc_id = s.item_id),
predictions AS (
  SELECT *, CAST(round(p_ens * 1e6::DOUBLE) AS BIGINT) AS p_micro,
         ln(least(greatest(p_ens, 1e-6::DOUBLE), (1.0::DOUBLE - 1e-6::DOUBLE))
            / (1.0::DOUBLE - least(greatest(p_ens, 1e-6::DOUBLE), (1.0::DOUBLE - 1e-6::DOUBLE)))) AS logit
  FROM ensembled)
"""


def with_views(*parts: str) -> str:
    """``WITH items, ...`` in front of a query."""
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n"
