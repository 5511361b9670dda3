"""Counts, profiles, exact copies, leakage, near-duplicates, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import components as comp
from curatrix.operators import labels as lb
from curatrix.operators import profile as pr
from curatrix.operators.neardup import first_pairs, near_dup_blocks
from curatrix.operators.stems import min_distance_by_stem
from curatrix.plans.cleaning import find_leakage
from curatrix.plans.oracle_views import FINGERPRINTS, ITEMS, METRICS, PAIRS, with_views
from curatrix.plans.registry import query
from curatrix.session import materialize
from curatrix.sources import tables as t

NAMED_SPLITS = "string_agg(DISTINCT split, '+' ORDER BY split)"
NAMED_CLASSES = "string_agg(DISTINCT class, '+' ORDER BY class)"

GROUPS = f"""
grp AS (SELECT content_md5, count(*) AS n_items, count(*) - 1 AS surplus, min(item_id) AS first_id, {NAMED_SPLITS} AS splits, {NAMED_CLASSES} AS classes
  FROM items GROUP BY content_md5 HAVING count(*) > 1)"""


def _hashed(spark, d):
    """Items with their content hash, written once: the text is read a single time."""
    return materialize(t.items(spark, d).select("item_id", "split", "class", "content_md5"), "items")


@query("counts_cube", with_views(ITEMS) + r"""
SELECT coalesce(split, 'all') AS split, coalesce(class, 'all') AS class, count(*) AS n,
       round(count(*)::DOUBLE / (SELECT count(*) FROM items), 6) AS share
FROM items GROUP BY CUBE (split, class)""")
def counts_cube(spark, d):
    return pr.counts(t.items(spark, d))


@query("metric_profile", with_views(ITEMS, METRICS) + "UNION ALL ".join(f"""
SELECT '{c}' AS metric, count({c}) AS n, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
       round(median({c}::DOUBLE), 6) AS median, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_pop({c}::DOUBLE), 6) AS std FROM metrics
""" for c in pr.PROFILE_COLUMNS))
def metric_profile(spark, d):
    return pr.profile(materialize(t.item_metrics(spark, d).select(*pr.PROFILE_COLUMNS), "metrics"))


@query("price_profile", "UNION ALL ".join(f"""
SELECT '{c}' AS metric, count({c}) AS n, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max,
       round(median({c}), 6) AS median, round(avg({c}::DECIMAL(18, 4))::DOUBLE, 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem
""" for c in ("l_quantity", "l_discount", "l_tax")))
def price_profile(spark, d):
    return pr.profile(t.table(spark, d, "lineitem"), ("l_quantity", "l_discount", "l_tax"))


@query("flag_rates", with_views(ITEMS, METRICS) + "UNION ALL ".join(f"""
SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n_flagged, round(100.0::DOUBLE * count(*) FILTER (WHERE {f}) / {'count(*)' if f == 'is_corrupt' else 'count(*) FILTER (WHERE NOT is_corrupt)'}, 6) AS percent FROM metrics
""" for f in pr.FLAG_COLUMNS))
def flag_rates(spark, d):
    return pr.flag_rates(t.item_metrics(spark, d))


@query("class_balance", with_views(ITEMS) + r"""
SELECT split, count(*) FILTER (WHERE class = 'Fake') AS n_fake, count(*) FILTER (WHERE class = 'Real') AS n_real,
       round(abs(count(*) FILTER (WHERE class = 'Fake') - count(*) FILTER (WHERE class = 'Real'))::DOUBLE / count(*), 6) AS imbalance
FROM items GROUP BY split""")
def class_balance(spark, d):
    return pr.class_balance(t.items(spark, d))


@query("metric_histogram", with_views(ITEMS, METRICS, r"""
lim AS (SELECT min(brightness) AS lo, max(brightness) AS hi FROM metrics),
cnt AS (SELECT class, CAST(least(floor((brightness - lo) * 40 / (hi - lo)), 39) AS INTEGER) AS bin, count(*) AS n FROM metrics, lim WHERE brightness IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT class, sum(n) AS total FROM cnt GROUP BY class)""") + r"""
SELECT t.class, CAST(r.bin AS INTEGER) AS bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n, round(lo + r.bin * ((hi - lo) / 40), 6) AS lower, round(lo + (r.bin + 1) * ((hi - lo) / 40), 6) AS upper,
       round(coalesce(c.n, 0)::DOUBLE / (t.total * ((hi - lo) / 40)), 6) AS density
FROM tot t CROSS JOIN range(40) r(bin) CROSS JOIN lim LEFT JOIN cnt c ON c.class = t.class AND c.bin = r.bin""")
def metric_histogram(spark, d):
    readable = t.item_metrics(spark, d).where(~F.col("is_corrupt")).select("class", "brightness")
    return pr.histogram(materialize(readable, "brightness"), "brightness", 40, by=["class"], density=True)


@query("event_histogram", r"""
WITH lim AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
cnt AS (SELECT CAST(least(floor((value - lo) * 50 / (hi - lo)), 49) AS INTEGER) AS bin, count(*) AS n FROM events, lim WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(lo + r.bin * ((hi - lo) / 50), 6) AS lower, round(lo + (r.bin + 1) * ((hi - lo) / 50), 6) AS upper
FROM range(50) r(bin) CROSS JOIN lim LEFT JOIN cnt c ON c.bin = r.bin""")
def event_histogram(spark, d):
    return pr.histogram(t.table(spark, d, "events"), "value", 50)


@query("exact_dup_groups", with_views(ITEMS, GROUPS) + "SELECT * FROM grp")
def exact_dup_groups(spark, d):
    return pr.exact_dup_groups(t.items(spark, d)).drop("split_mask", "class_mask")


@query("exact_dup_members", with_views(ITEMS, GROUPS) + r"""
SELECT i.item_id, i.split, i.class, content_md5, g.n_items, g.first_id FROM items i JOIN grp g USING (content_md5)""")
def exact_dup_members(spark, d):
    return pr.exact_dup_members(_hashed(spark, d)).drop("splits", "classes")


@query("exact_dup_members_heavy", with_views(ITEMS, GROUPS) + r"""
SELECT i.item_id, i.split, i.class, content_md5, g.n_items, g.first_id FROM items i JOIN grp g USING (content_md5)""")
def exact_dup_members_heavy(spark, d):
    """The same members with three groups joined as heavy ones and the others by the shuffle."""
    return pr.exact_dup_members(_hashed(spark, d), heavy=3).drop("splits", "classes")


@query("cross_split_exact", with_views(ITEMS, GROUPS) + r"""
SELECT splits, count(*) AS n_groups, CAST(sum(n_items) AS BIGINT) AS n_files, count(*) FILTER (WHERE classes NOT LIKE '%+%') AS consistent,
       count(*) FILTER (WHERE classes LIKE '%+%') AS conflicting FROM grp WHERE splits LIKE '%+%' GROUP BY splits""")
def cross_split_exact(spark, d):
    return pr.cross_split_exact(pr.exact_dup_groups(t.items(spark, d)))


@query("shared_hash_matrix", with_views(ITEMS, r"""
dis AS (SELECT DISTINCT split, content_md5 FROM items), names(a, b) AS (VALUES ('Train', 'Validation'), ('Train', 'Test'), ('Validation', 'Test'))""") + r"""
SELECT a AS split_a, b AS split_b, (SELECT count(*) FROM dis x JOIN dis y USING (content_md5) WHERE x.split = a AND y.split = b) AS n_shared FROM names""")
def shared_hash_matrix(spark, d):
    return pr.shared_hash_matrix(t.items(spark, d))


@query("shared_hash_items", with_views(ITEMS, GROUPS) + r"""
SELECT content_md5, i.item_id, i.split, i.class FROM items i JOIN grp USING (content_md5) WHERE grp.splits LIKE '%+%'""")
def shared_hash_items(spark, d):
    return pr.shared_hash_items(_hashed(spark, d))


@query("stem_reuse", with_views(ITEMS, f"""
st AS (SELECT stem, count(*) AS n, {NAMED_SPLITS} AS splits FROM items GROUP BY stem HAVING count(DISTINCT split) > 1)""") + r"""
SELECT splits, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_items FROM st GROUP BY splits""")
def stem_reuse(spark, d):
    return pr.reuse_by_split_set(t.items(spark, d), "stem")


@query("label_conflicts", with_views(ITEMS, GROUPS) + r"""
SELECT content_md5, n_items, splits, splits LIKE '%+%' AS crosses_splits FROM grp WHERE classes LIKE '%+%'""")
def label_conflicts(spark, d):
    return pr.label_conflicts(pr.exact_dup_groups(t.items(spark, d)))


@query("scene_buckets", with_views(ITEMS, FINGERPRINTS, f"""
sc AS (SELECT fp, count(*) AS n, {NAMED_SPLITS} AS splits FROM fps GROUP BY fp HAVING count(DISTINCT split) > 1)""") + r"""
SELECT splits, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_items FROM sc GROUP BY splits""")
def scene_buckets(spark, d):
    return pr.reuse_by_split_set(t.fingerprints(spark, d), "fp")


# --- near-duplicates ---------------------------------------------------------

CELLS = FINGERPRINTS + r""",
cells AS (SELECT fp, split, class, count(*) AS n, min(item_id) AS first_id FROM fps GROUP BY fp, split, class),
blk AS (
  SELECT a.first_id AS first_id_a, b.first_id AS first_id_b, CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance, a.split AS split_a, b.split AS split_b,
         a.class AS class_a, b.class AS class_b, a.n AS n_a, b.n AS n_b,
         CASE WHEN a.first_id = b.first_id THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END AS n_pairs
  FROM cells a JOIN cells b ON a.first_id <= b.first_id AND bit_count(xor(a.fp, b.fp)) <= 5)"""


def _by_first_id(blocks):
    """Sides in the order of their smallest ids, fingerprints left out."""
    swap = F.col("first_id_a") > F.col("first_id_b")
    pairs = [(F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"),
              F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b")) for c in ("first_id", "split", "class", "n")]
    return blocks.select("distance", "n_pairs", *[x for p in pairs for x in p])


def _blocks_sql(where: str) -> str:
    return with_views(ITEMS, CELLS) + f"SELECT * FROM blk WHERE n_pairs > 0 AND {where}"


def _fps(spark, d):
    return materialize(t.fingerprints(spark, d), "fingerprints")


@query("near_dups_cross_split", _blocks_sql("split_a <> split_b"))
def near_dups_cross_split(spark, d):
    return _by_first_id(near_dup_blocks(t.fingerprints(spark, d), scope="cross_split"))


@query("near_dups_crowded", _blocks_sql("split_a <> split_b"))
def near_dups_crowded(spark, d):
    """The same blocks with every bucket of more than four fingerprints cut again and compared in tiles."""
    return _by_first_id(near_dup_blocks(t.fingerprints(spark, d), scope="cross_split", hot_bucket=4))


@query("near_dups_same_split_class", _blocks_sql("split_a = split_b AND class_a = class_b"))
def near_dups_same_split_class(spark, d):
    return _by_first_id(near_dup_blocks(t.fingerprints(spark, d), scope="same_split_class"))


@query("near_dups_cross_class", _blocks_sql("class_a <> class_b"))
def near_dups_cross_class(spark, d):
    return _by_first_id(near_dup_blocks(t.fingerprints(spark, d), scope="cross_class"))


@query("near_dup_summary", with_views(ITEMS, PAIRS) + r"""
SELECT least(split_a, split_b) || '+' || greatest(split_a, split_b) AS split_pair, distance, count(*) AS n_pairs,
       count(*) FILTER (WHERE class_a = class_b) AS consistent, count(*) FILTER (WHERE class_a <> class_b) AS conflicting
FROM pairs WHERE split_a <> split_b GROUP BY 1, 2""")
def near_dup_summary(spark, d):
    from curatrix.operators.neardup import near_dup_summary as summary
    return summary(near_dup_blocks(t.fingerprints(spark, d), scope="cross_split"))


TOUCH = r"SELECT id_a, id_b, distance, split_a, split_b, class_a, class_b, class_a <> class_b AS label_conflict FROM pairs "


@query("pairs_conflicting", with_views(ITEMS, PAIRS) + TOUCH + "WHERE split_a <> split_b AND class_a <> class_b ORDER BY distance, id_a, id_b LIMIT 40")
def pairs_conflicting(spark, d):
    fps = _fps(spark, d)
    return first_pairs(near_dup_blocks(fps).where("class_a <> class_b"), fps, 40)


@query("pairs_consistent", with_views(ITEMS, PAIRS) + TOUCH + "WHERE split_a <> split_b AND class_a = class_b ORDER BY distance, id_a, id_b LIMIT 40")
def pairs_consistent(spark, d):
    fps = _fps(spark, d)
    return first_pairs(near_dup_blocks(fps).where("class_a = class_b"), fps, 40)


@query("pairs_touching_test", with_views(ITEMS, PAIRS) + TOUCH + "WHERE split_a <> split_b AND 'Test' IN (split_a, split_b) ORDER BY distance, id_a, id_b LIMIT 40")
def pairs_touching_test(spark, d):
    fps = _fps(spark, d)
    return first_pairs(near_dup_blocks(fps).where("split_a = 'Test' or split_b = 'Test'"), fps, 40)


@query("pairs_within_class", with_views(ITEMS, PAIRS) + TOUCH + "WHERE split_a = split_b AND class_a = class_b ORDER BY distance, id_a, id_b LIMIT 100")
def pairs_within_class(spark, d):
    fps = _fps(spark, d)
    return first_pairs(near_dup_blocks(fps, scope="same_split_class"), fps, 100)


@query("min_distance_by_stem", with_views(ITEMS, FINGERPRINTS, r"""
stemmed AS (SELECT i.stem, f.* FROM fps f JOIN items i USING (item_id)),
reused AS (SELECT stem, count(*) AS n_items FROM items GROUP BY stem HAVING count(DISTINCT split) > 1)""") + r"""
SELECT r.stem, r.n_items, CAST(min(bit_count(xor(a.fp, b.fp))) AS INTEGER) AS min_distance
FROM reused r JOIN stemmed a USING (stem) JOIN stemmed b ON b.stem = a.stem AND a.item_id < b.item_id GROUP BY r.stem, r.n_items""")
def min_distance(spark, d):
    fps = t.fingerprints(spark, d).withColumn("stem", F.expr("item_id div 10"))
    return min_distance_by_stem(materialize(fps, "fingerprints"))


# --- components and cleaning -------------------------------------------------

GRAPH = PAIRS + r""",
exact_span AS (SELECT content_md5, min(item_id) AS copy_node, count(*) AS copies FROM items GROUP BY content_md5 HAVING count(DISTINCT split) > 1),
edge AS (
  SELECT id_a AS a, id_b AS b FROM pairs WHERE split_a <> split_b
  UNION SELECT i.item_id, e.copy_node FROM items i JOIN exact_span e USING (content_md5) WHERE i.item_id <> e.copy_node),
sym AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT DISTINCT a AS item_id, a AS root FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.item_id),
member AS (SELECT r.item_id, min(r.root) AS component, any_value(i.split) AS split, any_value(i.class) AS class FROM reach r JOIN items i USING (item_id) GROUP BY r.item_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY CASE split WHEN 'Test' THEN 0 WHEN 'Validation' THEN 1 ELSE 2 END, item_id) AS place,
         first_value(item_id) OVER (PARTITION BY component ORDER BY CASE split WHEN 'Test' THEN 0 WHEN 'Validation' THEN 1 ELSE 2 END, item_id) AS kept_id,
         min(CASE split WHEN 'Test' THEN 0 WHEN 'Validation' THEN 1 ELSE 2 END) OVER (PARTITION BY component) AS best,
         CASE split WHEN 'Test' THEN 0 WHEN 'Validation' THEN 1 ELSE 2 END AS priority
  FROM member)"""


@query("duplicate_edges", with_views(ITEMS, PAIRS, r"""
site AS (SELECT fp, split, min(item_id) AS node FROM fps GROUP BY fp, split),
near AS (SELECT DISTINCT least(x.node, y.node) AS a, greatest(x.node, y.node) AS b FROM pairs p
  JOIN site x ON x.fp = p.fp_a AND x.split = p.split_a JOIN site y ON y.fp = p.fp_b AND y.split = p.split_b WHERE p.split_a <> p.split_b),
exact_span AS (SELECT content_md5, min(item_id) AS copy_node FROM items GROUP BY content_md5 HAVING count(DISTINCT split) > 1),
chain AS (SELECT DISTINCT s.node AS x, e.copy_node AS y FROM fps f JOIN exact_span e USING (content_md5) JOIN site s ON s.fp = f.fp AND s.split = f.split)""") + r"""
SELECT a, b FROM near UNION SELECT least(x, y), greatest(x, y) FROM chain WHERE x <> y""")
def duplicate_edges(spark, d):
    fps = _fps(spark, d)
    edges, _ = comp.duplicate_graph(fps, materialize(near_dup_blocks(fps), "blocks"), comp.spanning_groups(fps))
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("components", with_views(ITEMS, GRAPH) + "SELECT item_id, split, class, component FROM member")
def components(spark, d):
    return comp.duplicate_components(_fps(spark, d))


@query("keep_one", with_views(ITEMS, GRAPH) + "SELECT item_id, split, class, component, kept_id FROM ranked WHERE place > 1")
def keep_one(spark, d):
    return find_leakage(t.fingerprints(spark, d)).removed


@query("keep_best_split", with_views(ITEMS, GRAPH) + "SELECT item_id, split, class, component, kept_id FROM ranked WHERE priority > best")
def keep_best_split(spark, d):
    return find_leakage(t.fingerprints(spark, d), keep="best_split").removed


@query("removal_report", with_views(ITEMS, GRAPH) + r"""
SELECT i.split, i.class, count(*) FILTER (WHERE r.place > 1) AS removed, count(*) AS total FROM items i LEFT JOIN ranked r USING (item_id) GROUP BY i.split, i.class""")
def removal_report(spark, d):
    return find_leakage(t.fingerprints(spark, d)).report()


@query("dedup_summary", with_views(ITEMS, GRAPH) + r"""
SELECT (SELECT count(*) FROM pairs WHERE split_a <> split_b) AS pairs_loaded,
       CAST((SELECT count(*) FROM pairs WHERE split_a <> split_b) + (SELECT sum(copies - 1) FROM exact_span) AS BIGINT) AS edges_used,
       (SELECT count(DISTINCT component) FROM member) AS components_spanning_splits, (SELECT count(*) FROM ranked WHERE place > 1) AS files_quarantined""")
def dedup_summary(spark, d):
    return find_leakage(t.fingerprints(spark, d)).summary()


@query("clean_training_set", with_views(ITEMS, GRAPH) + r"""
SELECT item_id, split, class FROM items WHERE item_id NOT IN (SELECT item_id FROM ranked WHERE place > 1)""")
def clean_training_set(spark, d):
    result = find_leakage(t.fingerprints(spark, d))
    return lb.exclude(result.items.select("item_id", "split", "class"), result.removed)


# --- summary -----------------------------------------------------------------



def _summary_sql(tail: str) -> str:
    pairs_after_tokens = PAIRS[PAIRS.index("words AS"):]
    return with_views(ITEMS, METRICS, pairs_after_tokens, r"""
ok AS (SELECT * FROM metrics WHERE NOT is_corrupt),
dup AS (SELECT file_hash, count(*) AS n, count(DISTINCT split) AS ns FROM ok GROUP BY file_hash HAVING count(*) > 1),
summary AS (
  SELECT (SELECT count(*) FROM metrics) AS total_images, count(*) AS valid_images, (SELECT count(*) FROM metrics WHERE is_corrupt) AS corrupt_images,
    count(*) FILTER (WHERE class = 'Fake') AS class_fake, count(*) FILTER (WHERE class = 'Real') AS class_real,
    count(*) FILTER (WHERE split = 'Train') AS split_train, count(*) FILTER (WHERE split = 'Validation') AS split_validation, count(*) FILTER (WHERE split = 'Test') AS split_test,
    count(*) FILTER (WHERE is_low_res) AS low_resolution_count, count(*) FILTER (WHERE is_blurry) AS blurry_count, count(*) FILTER (WHERE is_blank) AS blank_count,
    count(*) FILTER (WHERE is_dark) AS very_dark_count, count(*) FILTER (WHERE is_bright) AS very_bright_count, count(*) FILTER (WHERE is_non_square) AS non_square_count,
    (SELECT count(*) FROM dup) AS exact_duplicate_groups, CAST((SELECT coalesce(sum(n - 1), 0) FROM dup) AS BIGINT) AS total_duplicate_files,
    (SELECT count(*) FROM pairs WHERE split_a = split_b AND class_a = class_b) AS near_duplicate_pairs,
    (SELECT count(*) FROM dup WHERE ns > 1) > 0 AS cross_split_leakage
  FROM ok)""") + tail


def _audit_parts(spark, d):
    metrics = materialize(t.item_metrics(spark, d), "metrics")
    return metrics, near_dup_blocks(t.fingerprints(spark, d), scope="same_split_class")


@query("audit_summary", _summary_sql("SELECT * FROM summary"))
def audit_summary(spark, d):
    metrics, near = _audit_parts(spark, d)
    return pr.audit_summary(metrics, near)


@query("issue_ranking", _summary_sql(r""", bal AS (
  SELECT split, abs(count(*) FILTER (WHERE class = 'Fake') - count(*) FILTER (WHERE class = 'Real'))::DOUBLE / count(*) AS x FROM ok GROUP BY split),
iss(position, severity, issue, amount) AS (
  SELECT 1, CASE WHEN corrupt_images > 0 THEN 'HIGH' END, 'corrupt files', corrupt_images::DOUBLE FROM summary
  UNION ALL SELECT 2, CASE WHEN total_duplicate_files > 0 THEN 'HIGH' END, 'exact duplicates', total_duplicate_files FROM summary
  UNION ALL SELECT 3, CASE WHEN cross_split_leakage THEN 'CRITICAL' END, 'cross-split leakage', 1 FROM summary
  UNION ALL SELECT 4, CASE WHEN near_duplicate_pairs > 100 THEN 'HIGH' WHEN near_duplicate_pairs > 0 THEN 'MEDIUM' END, 'near duplicates', near_duplicate_pairs FROM summary
  UNION ALL SELECT 5, CASE WHEN low_resolution_count > valid_images * 0.01 THEN 'MEDIUM' WHEN low_resolution_count > 0 THEN 'LOW' END, 'low resolution', low_resolution_count FROM summary
  UNION ALL SELECT 6, CASE WHEN blurry_count > valid_images * 0.05 THEN 'MEDIUM' WHEN blurry_count > 0 THEN 'LOW' END, 'blurry', blurry_count FROM summary
  UNION ALL SELECT 7, CASE WHEN blank_count > 0 THEN 'HIGH' END, 'blank', blank_count FROM summary
  UNION ALL SELECT 8, CASE WHEN x > 0.10 THEN 'HIGH' WHEN x > 0.05 THEN 'MEDIUM' END, 'class imbalance ' || split, round(x, 6) FROM bal
  UNION ALL SELECT 9, CASE WHEN very_dark_count > valid_images * 0.02 THEN 'LOW' END, 'very dark', very_dark_count FROM summary
  UNION ALL SELECT 10, CASE WHEN very_bright_count > valid_images * 0.02 THEN 'LOW' END, 'very bright', very_bright_count FROM summary
  UNION ALL SELECT 11, CASE WHEN non_square_count > valid_images * 0.1 THEN 'LOW' END, 'non-square', non_square_count FROM summary)
SELECT CAST(row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, position, issue) AS INTEGER) AS place,
       severity, issue, amount FROM iss WHERE severity IS NOT NULL""").replace("  FROM ok)\n,", "  FROM ok),", 1))
def issue_ranking(spark, d):
    metrics, near = _audit_parts(spark, d)
    return pr.issue_ranking(pr.audit_summary(metrics, near), pr.class_balance(metrics.where("not is_corrupt")))


@query("error_list", with_views(ITEMS, METRICS) + "SELECT item_id, split, class, error FROM metrics WHERE is_corrupt")
def error_list(spark, d):
    return pr.error_list(t.item_metrics(spark, d))


@query("head_per_list", with_views(ITEMS) + r"""
SELECT split, class, item_id, CAST(place AS INTEGER) AS place FROM (
  SELECT split, class, item_id, row_number() OVER (PARTITION BY split, class ORDER BY file_size DESC, item_id) AS place FROM items) WHERE place <= 10""")
def head_per_list(spark, d):
    lists = t.items(spark, d).select("split", "class", "item_id", "file_size")
    return pr.head_per_list(lists, ["split", "class"], [F.col("file_size").desc(), "item_id"], 10).drop("file_size")
