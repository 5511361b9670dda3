"""Mining, sampling, logs, sets, baseline scoring, sources and sinks, pixels and the stream."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions import scalar as sc
from curatrix.operators import calibration as cal
from curatrix.operators import investigate as inv
from curatrix.operators import labels as lb
from curatrix.operators import metrics as m
from curatrix.operators import pixels as px
from curatrix.operators import profile as pr
from curatrix.operators import sampling as sp
from curatrix.plans.audit_queries import GRAPH
from curatrix.plans.cleaning import find_leakage
from curatrix.plans.oracle_views import ITEMS, METRICS, PREDICTIONS, with_views
from curatrix.plans.registry import query
from curatrix.plans.score_queries import COHORT_ROWS, COHORTS, OUTCOME, RATES, cells, scored
from curatrix.session import materialize, scratch_path
from curatrix.sources import images as im
from curatrix.sources import loose
from curatrix.sources import quarantine as qu
from curatrix.sources import reports as rp
from curatrix.sources import tables as t
from curatrix.streaming import scoring

TIER = "CASE WHEN p_micro >= 800000 THEN 'hard' WHEN p_micro >= 650000 THEN 'medium' WHEN p_micro >= 520000 THEN 'easy' ELSE 'below' END"


@query("mine_hard_negatives", with_views(ITEMS, PREDICTIONS) + f"SELECT item_id, p_micro, {TIER} AS tier FROM predictions WHERE label = 0 AND p_micro >= 480000")
def mine_hard_negatives(spark, d):
    return sp.mine_hard_negatives(scored(spark, d, "item_id", "label", "p_micro"), 0.48).select("item_id", "p_micro", "tier")


MINED = r"""count(*) FILTER (WHERE label = 0) AS n_real, count(*) FILTER (WHERE label = 0 AND p_micro >= 480000) AS fps_mined,
 count(*) FILTER (WHERE label = 0 AND p_micro >= 480000 AND p_micro < 520000) AS n_below, count(*) FILTER (WHERE label = 0 AND p_micro >= 520000 AND p_micro < 650000) AS n_easy,
 count(*) FILTER (WHERE label = 0 AND p_micro >= 650000 AND p_micro < 800000) AS n_medium, count(*) FILTER (WHERE label = 0 AND p_micro >= 800000) AS n_hard,
 round(count(*) FILTER (WHERE label = 0 AND p_micro >= 480000)::DOUBLE / greatest(count(*) FILTER (WHERE label = 0), 1), 6) AS fpr"""


@query("mining_report", with_views(ITEMS, PREDICTIONS) + f"SELECT split, {MINED} FROM predictions GROUP BY split")
def mining_report(spark, d):
    return sp.mining_report(t.predictions(spark, d), 0.48, by=["split"])


@query("cap_per_class", with_views(ITEMS) + r"""
SELECT item_id, class FROM (SELECT item_id, class, row_number() OVER (PARTITION BY class ORDER BY item_id) AS place FROM items) WHERE place <= 100""")
def cap_per_class(spark, d):
    return sp.cap_per_class(t.items(spark, d).select("item_id", "class"), 100)


@query("top_false_positives", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, p_micro, CAST(row_number() OVER (ORDER BY p_micro DESC, item_id) AS INTEGER) AS rank FROM predictions WHERE label = 0 AND p_micro >= 520000 ORDER BY p_micro DESC, item_id LIMIT 20""")
def top_false_positives(spark, d):
    fps = scored(spark, d, "item_id", "label", "p_micro").where("label = 0 and p_micro >= 520000").select("item_id", "p_micro")
    return pr.top_k(fps, [F.col("p_micro").desc(), "item_id"], 20)


@query("export_samples", with_views(ITEMS, PREDICTIONS, r"""
r AS (SELECT item_id, p_micro, row_number() OVER (ORDER BY p_micro DESC, item_id) AS rank FROM predictions WHERE label = 0)""") + r"""
SELECT item_id, p_micro, CAST(rank AS INTEGER) AS rank, 'hn_' || printf('%03d', rank - 1) || '_p' || format('{:.3f}', round(p_micro / 1000000.0::DOUBLE, 3)) || '_' || item_id AS sample_name FROM r WHERE rank <= 50""")
def export_samples(spark, d):
    return rp.export_samples(scored(spark, d, "item_id", "label", "p_micro").where("label = 0").select("item_id", "p_micro"), 50, "hn")


SEEDED = "md5('7:' || CAST(item_id AS VARCHAR))"


@query("shuffle_order", with_views(ITEMS) + f"SELECT item_id, split, {SEEDED} AS place_key FROM items")
def shuffle_order(spark, d):
    return sp.shuffle(t.items(spark, d).select("item_id", "split", sp.seeded_key(F.col("item_id"), 7).alias("place_key")), 7)


@query("sample_items", with_views(ITEMS, PREDICTIONS) + f"SELECT item_id, p_micro FROM predictions WHERE p_micro BETWEEN 350000 AND 650000 ORDER BY {SEEDED}, item_id LIMIT 24")
def sample_items(spark, d):
    return sp.sample_n(lb.ambiguous(scored(spark, d, "item_id", "p_micro")), 24, 7)


@query("oversample", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, CAST(c AS INTEGER) AS copy FROM predictions, range(1, 4) g(c) WHERE label = 0 AND p_micro >= 520000""")
def oversample(spark, d):
    return sp.oversample(sp.mine_hard_negatives(scored(spark, d, "item_id", "label", "p_micro")).select("item_id"), 3)


@query("weighted_sample", with_views(ITEMS, PREDICTIONS, r"""
wt AS (SELECT item_id, CASE WHEN label = 0 AND p_micro >= 520000 THEN 2 ELSE 1 END AS weight, substr(md5(CAST(item_id AS VARCHAR)), 1, 3) AS b FROM predictions),
line AS (SELECT item_id, weight, sum(weight) OVER (ORDER BY b, item_id) - weight AS lo, sum(weight) OVER (ORDER BY b, item_id) AS hi FROM wt),
draws AS (SELECT i AS draw, CAST('0x' || substr(md5('11:' || i), 1, 12) AS BIGINT) % (SELECT CAST(sum(weight) AS BIGINT) FROM wt) AS u FROM range((SELECT count(*) FROM wt)) g(i))""") + r"""
SELECT draw, item_id, weight FROM draws JOIN line ON u >= lo AND u < hi""")
def weighted_sample(spark, d):
    weight = F.when((F.col("label") == 0) & (F.col("p_micro") >= 520000), 2).otherwise(1)
    items = materialize(t.predictions(spark, d).select("item_id", weight.alias("weight")), "weights")
    return sp.weighted_sample(items, "weight", None, 11)


SEATED = r"""
WITH b AS (SELECT vec_id AS item_id, label, embedding, CAST(CAST('0x' || substr(md5('5:' || vec_id), 1, 12) AS BIGINT) % (SELECT CAST(ceil(count(*) / 32.0::DOUBLE) AS BIGINT) FROM embeddings) AS INTEGER) AS batch,
  md5('6:' || vec_id) AS k FROM embeddings)"""


@query("mixup_partners", SEATED + r"""
SELECT item_id, batch, coalesce(lead(item_id) OVER w, first_value(item_id) OVER w) AS partner_id, label AS label_a,
       coalesce(lead(label) OVER w, first_value(label) OVER w) AS label_b FROM b WINDOW w AS (PARTITION BY batch ORDER BY k, item_id)""")
def mixup_partners(spark, d):
    vectors = t.table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id")
    return sp.mixup(vectors, "embedding", "label", 32, 0.4, 5).drop("mixed", "lam")


@query("mixup_vectors", SEATED + r""",
s AS (SELECT *, coalesce(lead(item_id) OVER w, first_value(item_id) OVER w) AS partner_id, coalesce(lead(embedding) OVER w, first_value(embedding) OVER w) AS mate,
  CAST('0x' || substr(md5('5:' || batch), 1, 12) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS lam FROM b WINDOW w AS (PARTITION BY batch ORDER BY k, item_id)),
e AS (SELECT item_id, partner_id, batch, lam, unnest(range(1, len(embedding) + 1)) AS i, embedding, mate FROM s),
v AS (SELECT item_id, partner_id, batch, lam, i, lam * embedding[i] + (1 - lam) * mate[i] AS v FROM e)
SELECT item_id, partner_id, batch, round(lam, 6) AS lam, CAST(count(*) AS INTEGER) AS size, round(max(v), 4) AS largest, round(min(v), 4) AS smallest FROM v GROUP BY ALL""")
def mixup_vectors(spark, d):
    """Blended with a uniform draw for each batch."""
    vectors = t.table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id")
    return sp.mixup(vectors, "embedding", "label", 32, 1, 5).select(
        "item_id", "partner_id", "batch", F.round("lam", 6).alias("lam"), F.size("mixed").alias("size"),
        F.round(F.array_max("mixed"), 4).alias("largest"), F.round(F.array_min("mixed"), 4).alias("smallest"))


@query("mixup_beta", SEATED + r""",
tries AS (SELECT batch, i, (CAST('0x' || substr(md5('5:' || batch || ':' || i || ':0'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
  (CAST('0x' || substr(md5('5:' || batch || ':' || i || ':1'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS v FROM (SELECT DISTINCT batch FROM b), range(30) g(i)),
drawn AS (SELECT batch, arg_min(pow(u, 2.5::DOUBLE) / (pow(u, 2.5::DOUBLE) + pow(v, 2.5::DOUBLE)), i) AS lam FROM tries WHERE pow(u, 2.5::DOUBLE) + pow(v, 2.5::DOUBLE) <= 1 GROUP BY batch),
s AS (SELECT *, coalesce(lead(embedding) OVER w, first_value(embedding) OVER w) AS mate FROM b JOIN drawn USING (batch) WINDOW w AS (PARTITION BY batch ORDER BY k, item_id))
SELECT item_id, batch, round(lam, 6) AS lam, round(lam * embedding[1] + (1 - lam) * mate[1], 4) AS leading FROM s""")
def mixup_beta(spark, d):
    """Blended with a draw of Beta(0.4, 0.4) for each batch."""
    vectors = t.table(spark, d, "embeddings").withColumnRenamed("vec_id", "item_id")
    return sp.mixup(vectors, "embedding", "label", 32, 0.4, 5).select(
        "item_id", "batch", F.round("lam", 6).alias("lam"), F.round(F.col("mixed")[0], 4).alias("leading"))


# --- logs --------------------------------------------------------------------

LOG = f"""
it AS (SELECT item_id % 20 AS iteration, {cells('p_micro >= 480000')}, {MINED.replace('AS fpr', 'AS mined_rate')} FROM predictions GROUP BY 1),
log AS (SELECT iteration, fps_mined, {RATES} FROM it)"""


def mining_log(spark, d):
    """A log derived from the scores: twenty iterations, whatever the number of items."""
    rows = scored(spark, d, "item_id", "label", "p_micro").withColumn("iteration", F.col("item_id") % 20)
    rates = m.confusion(rows, 0.48, by=["iteration"])
    mined = sp.mining_report(rows, 0.48, by=["iteration"]).select("iteration", "fps_mined")
    return rates.join(mined, "iteration").select("iteration", "fps_mined", "f1", "precision", "recall", "fpr")


@query("log_deltas", with_views(ITEMS, PREDICTIONS, LOG) + "UNION ALL ".join(f"""
SELECT '{c}' AS metric, round(arg_min({c}::DOUBLE, iteration), 6) AS first, round(arg_max({c}::DOUBLE, iteration), 6) AS last,
  round(arg_max({c}::DOUBLE, iteration) - arg_min({c}::DOUBLE, iteration), 6) AS delta FROM log """ for c in ("fps_mined", "f1", '"precision"', "fpr")).replace("'\"precision\"'", "'precision'"))
def log_deltas(spark, d):
    return sp.log_deltas(mining_log(spark, d), "iteration", ("fps_mined", "f1", "precision", "fpr"))


@query("best_epoch", with_views(ITEMS, PREDICTIONS, LOG, r"""
a AS (SELECT iteration, f1, row_number() OVER (ORDER BY iteration) AS r, f1 > coalesce(max(f1) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS improved,
  max(f1) OVER (ORDER BY iteration) AS best_so_far FROM log),
b AS (SELECT *, CAST(r - coalesce(max(CASE WHEN improved THEN r END) OVER (ORDER BY iteration), 0) AS INTEGER) AS epochs_no_improve FROM a)""") + r"""
SELECT iteration, f1, improved, best_so_far, epochs_no_improve,
  epochs_no_improve >= 3 AND NOT coalesce(bool_or(epochs_no_improve >= 3) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stops_here FROM b""")
def best_epoch(spark, d):
    return sp.best_epoch(mining_log(spark, d), "iteration", "f1", 3)


@query("append_log", with_views(ITEMS, PREDICTIONS) + f"SELECT CASE split WHEN 'Train' THEN 1 WHEN 'Validation' THEN 2 ELSE 3 END AS iteration, {MINED} FROM predictions GROUP BY split")
def append_log(spark, d):
    path = scratch_path(spark, "log")
    rows = scored(spark, d, "split", "label", "p_micro")
    for i, split in enumerate(("Train", "Validation", "Test"), 1):
        rp.append_log(sp.mining_report(rows.where(F.col("split") == split), 0.48).select(F.lit(i).alias("iteration"), "*"), path)
    return spark.read.parquet(path)


# --- sets --------------------------------------------------------------------

@query("union_training_rows", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, label, 'base' AS origin FROM predictions UNION ALL SELECT item_id, 0, 'hard negative' FROM predictions WHERE label = 0 AND p_micro >= 520000""")
def union_training_rows(spark, d):
    base = scored(spark, d, "item_id", "label", "p_micro")
    hard = sp.mine_hard_negatives(base).select("item_id", F.lit(0).alias("label"), F.lit("hard negative").alias("origin"))
    return base.select("item_id", "label", F.lit("base").alias("origin")).unionByName(hard)


@query("intersect_hashes", with_views(ITEMS) + "SELECT content_md5 FROM items WHERE split = 'Train' INTERSECT SELECT content_md5 FROM items WHERE split = 'Validation'")
def intersect_hashes(spark, d):
    items = materialize(t.items(spark, d).select("split", "content_md5"), "items")
    return items.where("split = 'Train'").select("content_md5").intersect(items.where("split = 'Validation'").select("content_md5"))


@query("difference_items", with_views(ITEMS) + "SELECT content_md5 FROM items WHERE split = 'Train' EXCEPT ALL SELECT content_md5 FROM items WHERE split <> 'Train'")
def difference_items(spark, d):
    items = materialize(t.items(spark, d).select("split", "content_md5"), "items")
    return items.where("split = 'Train'").select("content_md5").exceptAll(items.where("split <> 'Train'").select("content_md5"))


@query("distinct_cells", with_views(ITEMS) + "SELECT DISTINCT content_md5, split, class FROM items")
def distinct_cells(spark, d):
    return t.items(spark, d).select("content_md5", "split", "class").distinct()


# --- sources and sinks -------------------------------------------------------

@query("scan_items", with_views(ITEMS) + r"""
SELECT split, class, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS n_bytes FROM items GROUP BY split, class""")
def scan_items(spark, d):
    """Texts written below ``Split/Class``, found again by scanning the folder: bytes per split and class."""
    root = scratch_path(spark, "tree")
    texts = t.with_identity(t.documents(spark, d)).select("split", "class", "text")
    for split in cv.SPLITS:
        for kind in cv.CLASSES:
            texts.where((F.col("split") == split) & (F.col("class") == kind)).select("text").write.text(f"{root}/{split}/{kind}")
    return im.scan_items(spark, root, ["txt"]).groupBy("split", "class").agg(F.sum("file_size").alias("n_bytes")).where("n_bytes > 0")


REPORTED = r"""SELECT content_md5 AS hash, CAST(item_id AS VARCHAR) AS path FROM items WHERE content_md5 IN (SELECT content_md5 FROM items GROUP BY 1 HAVING count(*) > 1)"""


@query("read_report", with_views(ITEMS) + REPORTED)
def read_report(spark, d):
    """Groups written as JSON reports, one object for each hash, read back by the operator and opened."""
    items = materialize(t.items(spark, d).select("item_id", "split", "class", "content_md5"), "items")
    members = pr.exact_dup_members(items)
    path = scratch_path(spark, "report")
    member = members.select(F.create_map("content_md5", F.array(F.col("item_id").cast("string"))).alias("exact_duplicates"))
    rp.write_report({"groups": member}, path, "json")
    return rp.report_groups(rp.read_report(spark, f"{path}/groups", rp.AUDIT_REPORT, one_document=False))


@query("loose_report", with_views(ITEMS, r"""
lines AS (SELECT 'n' || (item_id % 10) AS k, item_id % 7 = 0 AS broken, file_size, class FROM items),
keys AS (SELECT k AS key, CASE WHEN class = 'Fake' THEN 'OBJECT<size: BIGINT>' ELSE 'STRING' END AS type, CASE WHEN class = 'Fake' THEN file_size END AS size FROM lines WHERE NOT broken
  UNION ALL SELECT 'class', 'STRING', NULL FROM lines WHERE NOT broken)""") + r"""
SELECT key, type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM keys GROUP BY key, type
UNION ALL SELECT '(damaged)', NULL, count(*), NULL FROM lines WHERE broken""")
def loose_report(spark, d):
    """Reports with keys of their own and values of two kinds, one in seven cut off, read without a schema: keys, types, sizes."""
    size = F.named_struct(F.lit("size"), "file_size")
    value = F.when(F.col("class") == "Fake", F.to_json(size)).otherwise(F.lit('"none"'))
    line = F.concat(F.lit('{"class":"'), "class", F.lit('","n'), (F.col("item_id") % 10).cast("string"), F.lit('":'), value)
    path = scratch_path(spark, "loose")
    t.items(spark, d).select(F.concat(line, F.when(F.col("item_id") % 7 == 0, "").otherwise("}"))).write.text(path)
    reports = loose.read_loose(spark, path, one_document=False)
    keys = loose.loose_entries(reports).groupBy("key", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(loose.loose_value("value", "$.size", "bigint")).alias("size"))
    damaged = reports.where("damaged is not null").agg(F.count(F.lit(1)).alias("n"))
    return keys.unionByName(damaged.select(F.lit("(damaged)").alias("key"), F.lit(None).cast("string").alias("type"), "n", F.lit(None).cast("bigint").alias("size")))


@query("write_report", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, label, p_micro FROM predictions WHERE p_micro BETWEEN 350000 AND 650000 ORDER BY p_micro DESC, item_id LIMIT 100")
def write_report(spark, d):
    path = scratch_path(spark, "report")
    rows = lb.ambiguous(scored(spark, d, "item_id", "label", "p_micro"))
    rp.write_report({"ambiguous": rows}, path, "parquet", {"ambiguous": ([F.col("p_micro").desc(), "item_id"], 100)})
    return spark.read.parquet(f"{path}/ambiguous")


@query("saved_predictions", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, label, p_micro FROM predictions")
def saved_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    t.predictions(spark, d).select("item_id", "label", "p_micro").write.parquet(path)
    return rp.read_predictions(spark, path)


@query("write_leakage_quarantine", with_views(ITEMS, GRAPH) + "SELECT item_id, split, class, component, kept_id FROM ranked WHERE place > 1")
def write_leakage_quarantine(spark, d):
    """Pairs across splits, their components, the removals as a manifest by split and class, read back."""
    path = scratch_path(spark, "quarantine")
    rp.write_quarantine(find_leakage(t.fingerprints(spark, d)).removed, path)
    return spark.read.parquet(path).select("item_id", "split", "class", "component", "kept_id")


@query("quarantine_restored", with_views(ITEMS, r"""
span AS (SELECT content_md5 FROM items GROUP BY content_md5 HAVING count(DISTINCT split) > 1),
shared AS (SELECT item_id, split, class FROM items WHERE content_md5 IN (SELECT content_md5 FROM span))""") + r"""
SELECT item_id, split, class, CAST(3 AS INTEGER) AS version,
  CASE WHEN split = 'Test' THEN 'stayed' ELSE 'entered' END AS change FROM shared
UNION ALL SELECT item_id, NULL, NULL, 3, 'left' FROM items WHERE split = 'Test' AND item_id NOT IN (SELECT item_id FROM shared)""")
def quarantine_restored(spark, d):
    """Cross-split copies in quarantine, replaced by the whole test split, then restored: what is in it, and what that changed."""
    path = scratch_path(spark, "versions")
    items = materialize(t.items(spark, d).select("item_id", "split", "class", "content_md5"), "items")
    spanning = items.groupBy("content_md5").agg(F.count_distinct("split").alias("n")).where("n > 1")
    qu.quarantine(items.join(spanning, "content_md5", "left_semi").drop("content_md5"), path)
    before = qu.quarantine(items.where("split = 'Test'").drop("content_md5"), path)
    version = qu.restore(spark, path, 1)
    changed = qu.changes(spark, path, before, version)
    return qu.read_quarantine(spark, path).join(changed, "item_id", "full").select(
        "item_id", "split", "class", F.lit(version).alias("version"), F.coalesce("change", F.lit("stayed")).alias("change"))


@query("mined_training_draw", with_views(ITEMS, PREDICTIONS, r"""
hard AS (SELECT item_id, row_number() OVER (ORDER BY p_micro DESC, item_id) AS place FROM predictions WHERE label = 0 AND p_micro >= 520000),
wt AS (SELECT item_id * 4 AS row_id, item_id, label, 1 AS weight FROM predictions
  UNION ALL SELECT item_id * 4 + c, item_id, 0, 2 FROM hard, range(1, 4) g(c)),
line AS (SELECT row_id, item_id, label, weight, sum(weight) OVER w - weight AS lo, sum(weight) OVER w AS hi FROM wt WINDOW w AS (ORDER BY substr(md5(CAST(row_id AS VARCHAR)), 1, 3), row_id)),
draws AS (SELECT i AS draw, CAST('0x' || substr(md5('13:' || i), 1, 12) AS BIGINT) % (SELECT CAST(sum(weight) AS BIGINT) FROM wt) AS u FROM range((SELECT count(*) FROM wt)) g(i))""") + r"""
SELECT draw, row_id, item_id, label, weight FROM draws JOIN line ON u >= lo AND u < hi""")
def mined_training_draw(spark, d):
    """Base rows and three copies of every hard negative, drawn with weights 1 and 2."""
    base = scored(spark, d, "item_id", "label", "p_micro")
    hard = sp.oversample(sp.mine_hard_negatives(base).select("item_id"), 3)
    rows = base.select((F.col("item_id") * 4).alias("row_id"), "item_id", "label", F.lit(1).alias("weight")).unionByName(
        hard.select((F.col("item_id") * 4 + F.col("copy")).alias("row_id"), "item_id", F.lit(0).alias("label"), F.lit(2).alias("weight")))
    return sp.weighted_sample(materialize(rows, "weighted-rows"), "weight", None, 13, key="row_id")


@query("write_quarantine", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, p.split, p.class FROM predictions p WHERE label = 0 AND p_micro >= 520000""")
def write_quarantine(spark, d):
    path = scratch_path(spark, "quarantine")
    rp.write_quarantine(sp.mine_hard_negatives(scored(spark, d, "item_id", "split", "class", "label", "p_micro")).select("item_id", "split", "class"), path)
    return spark.read.parquet(path).select("item_id", "split", "class")


# --- baseline scoring --------------------------------------------------------

FEATURES = ("brightness", "blur_score", "pixel_std", "file_size")


def _featured(spark, d):
    rows = t.predictions(spark, d).select("item_id", "split", "label_q")
    return materialize(t.item_metrics(spark, d).select("item_id", *FEATURES).join(rows, "item_id"), "features")


@query("fit_baseline")
def fit_baseline(spark, d):
    rows = _featured(spark, d)
    model = cal.fit_baseline(rows.where("split = 'Train'"), FEATURES, "label_q")
    threshold = m.choose_threshold(m.threshold_sweep(cal.score(model, rows.where("split = 'Validation'")), m.COARSE, "label_q"))
    return m.confusion(cal.score(model, rows.where("split = 'Test'")), threshold, "label_q").withColumn("threshold", F.lit(threshold))


def _signals():
    c = F.col
    return {"high_freq_ratio": c("pixel_std") / 8, "low_var_ratio": 1.0 / (1.0 + c("blur_score") / 50), "peak_ratio": c("brightness") / 1200,
            "edge_ratio": c("blur_score") / 400, "block_ratio": c("file_size") / 100_000.0, "symmetry_diff": c("pixel_std") * 4}


@query("score_model_stream")
def score_model_stream(spark, d):
    """The baseline fitted on the training split, then all items as a stream through it and through the heuristics."""
    rows = _featured(spark, d)
    model = cal.fit_baseline(rows.where("split = 'Train'"), FEATURES, "label_q")
    source, sink = scratch_path(spark, "arriving"), scratch_path(spark, "scored-items")
    t.item_metrics(spark, d).select("item_id", *FEATURES).write.parquet(source)
    arriving = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    scoring.stream_items(arriving, model, _signals(), sink, scratch_path(spark, "scored-items-state")).awaitTermination()
    return spark.read.parquet(sink)


@query("score_external", with_views(ITEMS, METRICS) + r"""
SELECT item_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-(brightness / 100 - blur_score / 80))), 6) AS p FROM metrics WHERE NOT is_corrupt""")
def score_external(spark, d):
    def load():
        weights = np.array([1 / 100, -1 / 80])
        return lambda batch: pd.Series(1 / (1 + np.exp(-(batch.to_numpy(dtype="float64") @ weights))))

    rows = t.item_metrics(spark, d).where("not is_corrupt")
    return cal.score_external(rows, load, ["brightness", "blur_score"]).withColumn("p", F.round("p", 6))


# --- pixels ------------------------------------------------------------------

# The bytes of every text as a colour image 48 pixels wide, three bytes (B, G, R) to a pixel, one row per pixel.
PIXELS = r"""
raw AS (SELECT item_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM items),
padded AS (SELECT item_id, n, h || repeat('20', CAST(144 * ceil(n / 144.0::DOUBLE) - n AS INTEGER)) AS h, CAST(ceil(n / 144.0::DOUBLE) AS BIGINT) AS height FROM raw),
pos AS (SELECT item_id, n, height, h, unnest(range(48 * height)) AS i FROM padded),
px AS (SELECT item_id, n, height, i // 48 AS y, i % 48 AS x, CAST('0x' || substr(h, 6 * i + 1, 2) AS BIGINT) AS b, CAST('0x' || substr(h, 6 * i + 3, 2) AS BIGINT) AS g,
  CAST('0x' || substr(h, 6 * i + 5, 2) AS BIGINT) AS r FROM pos),
luma AS (SELECT *, (19595 * r + 38470 * g + 7471 * b + 32768) // 65536 AS l FROM px)"""


CROP = "FILTER (WHERE y >= height // 2 - height // 6 AND y < height // 2 + height // 6 AND x >= 16 AND x < 32)"


def whole_variance(x: str, only: str = "") -> str:
    """Population variance of whole numbers from whole-number sums."""
    n, s1, s2 = f"count(*) {only}", f"sum({x}) {only}", f"sum({x} * {x}) {only}"
    return f"(({n} * {s2} - {s1} * {s1})::DOUBLE / ({n} * {n})::DOUBLE)"


ARTIFACTS = PIXELS + r""",
row_pass AS (SELECT *, coalesce(lead(l) OVER rw, l) - coalesce(lag(l) OVER rw, l) AS dx, coalesce(lag(l) OVER rw, l) + 2 * l + coalesce(lead(l) OVER rw, l) AS sm,
  coalesce(lag(l) OVER rw, 0) + coalesce(lead(l) OVER rw, 0) AS side,
  (6 * l + 4 * coalesce(lag(l) OVER rw, CASE WHEN height > 2 THEN lead(l) OVER rw ELSE l END) + 4 * coalesce(lead(l) OVER rw, CASE WHEN height > 2 THEN lag(l) OVER rw ELSE l END)
   + coalesce(lag(l, 2) OVER rw, CASE WHEN height > 2 THEN CASE WHEN x = 1 THEN l ELSE lead(l, 2) OVER rw END ELSE coalesce(lag(l) OVER rw, l) END)
   + coalesce(lead(l, 2) OVER rw, CASE WHEN height > 2 THEN CASE WHEN x = 46 THEN l ELSE lag(l, 2) OVER rw END ELSE coalesce(lead(l) OVER rw, l) END)) / 16.0::DOUBLE AS gs
  FROM luma WINDOW rw AS (PARTITION BY item_id, y ORDER BY x)),
lap AS (SELECT *, side + coalesce(lag(l) OVER cl, 0) + coalesce(lead(l) OVER cl, 0) - 4 * l AS e,
  coalesce(lag(dx) OVER cl, dx) + 2 * dx + coalesce(lead(dx) OVER cl, dx) AS gx, coalesce(lead(sm) OVER cl, sm) - coalesce(lag(sm) OVER cl, sm) AS gy,
  (6 * gs + 4 * coalesce(lag(gs) OVER cl, CASE WHEN height > 2 THEN lead(gs) OVER cl ELSE gs END) + 4 * coalesce(lead(gs) OVER cl, CASE WHEN height > 2 THEN lag(gs) OVER cl ELSE gs END)
   + coalesce(lag(gs, 2) OVER cl, CASE WHEN height > 2 THEN CASE WHEN y = 1 THEN gs ELSE lead(gs, 2) OVER cl END ELSE coalesce(lag(gs) OVER cl, gs) END)
   + coalesce(lead(gs, 2) OVER cl, CASE WHEN height > 2 THEN CASE WHEN y = height - 2 THEN gs ELSE lag(gs, 2) OVER cl END ELSE coalesce(lead(gs) OVER cl, gs) END)) / 16.0::DOUBLE AS blur,
  greatest(r, g, b) AS top, least(r, g, b) AS bot FROM row_pass WINDOW cl AS (PARTITION BY item_id, x ORDER BY y)),
half AS (SELECT item_id, y, x // 8 AS bx, u, sum(l * 0.5::DOUBLE * cos(pi() * (2 * (x % 8) + 1) * u / 16)) AS s FROM luma, range(1, 8) f(u)
  WHERE y // 8 < (height - 1) // 8 AND x // 8 < 5 GROUP BY item_id, y, x // 8, u),
coef AS (SELECT item_id, y // 8 AS by_, bx, u, v, abs(sum(s * 0.5::DOUBLE * cos(pi() * (2 * (y % 8) + 1) * v / 16))) AS c FROM half, range(1, 8) f(v) GROUP BY item_id, y // 8, bx, u, v),
dct AS (SELECT item_id, sum(c) * 49 / count(*) AS energy FROM coef GROUP BY item_id)""" + f""",
art AS (SELECT item_id, coalesce(any_value(energy), 0) AS avg_dct_energy, 100.0::DOUBLE * avg(CASE WHEN gx * gx + gy * gy > 22500 THEN 1 ELSE 0 END) AS edge_density_pct, avg(abs(l - blur)) AS noise_level, {whole_variance('e')} AS laplacian_var, avg(l) AS brightness, sqrt({whole_variance('l')}) AS contrast, avg(CASE WHEN top > 0 THEN round_even(255.0::DOUBLE * (top - bot) / top, 0) ELSE 0 END) AS saturation, any_value(n) / 1024.0::DOUBLE AS file_size_kb, coalesce(sqrt({whole_variance('l', CROP)}), 0) AS skin_smoothness_std
  FROM lap LEFT JOIN dct USING (item_id) GROUP BY item_id)"""


@query("image_artifacts", with_views(ITEMS, ARTIFACTS) + r"""
SELECT item_id, round(avg_dct_energy, 3) AS avg_dct_energy, round(edge_density_pct, 4) AS edge_density_pct, round(noise_level, 4) AS noise_level, round(laplacian_var, 4) AS laplacian_var, round(brightness, 4) AS brightness, round(contrast, 4) AS contrast, round(saturation, 4) AS saturation, round(file_size_kb, 4) AS file_size_kb, round(skin_smoothness_std, 4) AS skin_smoothness_std FROM art""")
def image_artifacts(spark, d):
    found = px.pixel_features(t.text_images(spark, d), "artifacts")
    return found.select("item_id", F.round("avg_dct_energy", 3).alias("avg_dct_energy"), *[F.round(c, 4).alias(c) for c in ("edge_density_pct", "noise_level")], *[F.round(c, 4).alias(c) for c in (
        "laplacian_var", "brightness", "contrast", "saturation", "file_size_kb", "skin_smoothness_std")])


@query("image_artifacts_all", with_views(ITEMS, ARTIFACTS) + r"""
SELECT item_id, round(avg_dct_energy, 1) AS avg_dct_energy, round(edge_density_pct, 2) AS edge_density_pct, round(noise_level, 2) AS noise_level, round(laplacian_var, 2) AS laplacian_var, round(brightness, 2) AS brightness, round(contrast, 2) AS contrast, round(saturation, 2) AS saturation, round(file_size_kb, 2) AS file_size_kb, round(skin_smoothness_std, 2) AS skin_smoothness_std FROM art""")
def image_artifacts_all(spark, d):
    """All artifact features in one row per image, to two decimals."""
    found = px.pixel_features(t.text_images(spark, d), "artifacts")
    return found.select("item_id", F.round("avg_dct_energy", 1).alias("avg_dct_energy"), *[F.round(c, 2).alias(c) for c in found.columns[1:] if c != "avg_dct_energy"])


@query("image_metrics", with_views(ITEMS, PIXELS, r"""
ch AS (SELECT item_id, r AS v FROM px UNION ALL SELECT item_id, g FROM px UNION ALL SELECT item_id, b FROM px),
sd AS (SELECT item_id, stddev_pop(v) AS pixel_std FROM ch GROUP BY item_id), br AS (SELECT item_id, avg(l) AS brightness FROM luma GROUP BY item_id)""") + r"""
SELECT item_id, round(brightness, 4) AS brightness, round(pixel_std, 4) AS pixel_std, brightness < 30 AS is_dark, brightness > 225 AS is_bright, pixel_std < 1.0 AS is_blank FROM br JOIN sd USING (item_id)""")
def image_metrics(spark, d):
    found = px.pixel_features(t.text_images(spark, d), "basic")
    b, s = F.col("brightness"), F.col("pixel_std")
    return found.select("item_id", F.round(b, 4).alias("brightness"), F.round(s, 4).alias("pixel_std"),
                        sc.is_dark(b).alias("is_dark"), sc.is_bright(b).alias("is_bright"), sc.is_blank(s).alias("is_blank"))


@query("image_dhash", with_views(ITEMS, PIXELS, r"""
rows_ AS (SELECT item_id, i, x, sum(greatest(0, least((i + 1) * height / 8.0::DOUBLE, y + 1) - greatest(i * height / 8.0::DOUBLE, y)) * 8 / height * l) AS v FROM luma, range(8) f(i) GROUP BY item_id, i, x),
cell AS (SELECT item_id, i, j, round(sum(greatest(0, least((j + 1) * 48 / 9.0::DOUBLE, x + 1) - greatest(j * 48 / 9.0::DOUBLE, x)) * 9 / 48 * v), 6) AS v FROM rows_, range(9) f(j) GROUP BY item_id, i, j),
bit AS (SELECT item_id, 8 * i + j AS k, v > lead(v) OVER (PARTITION BY item_id, i ORDER BY j) AS up, j FROM cell)""") + r"""
SELECT item_id, string_agg(CASE WHEN up THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM bit WHERE j < 8 GROUP BY item_id""")
def image_dhash(spark, d):
    found = px.pixel_features(t.text_images(spark, d), "hash")
    return found.select("item_id", F.lpad(F.bin("dhash"), 64, "0").alias("bits"))


LANCZOS = "CASE WHEN {t} = 0 THEN 1 WHEN abs({t}) < 3 THEN sin(pi() * {t}) / (pi() * {t}) * sin(pi() * {t} / 3) / (pi() * {t} / 3) ELSE 0 END"
WHOLE = "least(255, greatest(0, floor(round({v}, 6) + 0.5::DOUBLE)))"


@query("image_dhash_lanczos", with_views(ITEMS, PIXELS, rf"""
tx AS (SELECT j, x, (x + 0.5::DOUBLE - (j + 0.5::DOUBLE) * 48 / 9) / (48 / 9.0::DOUBLE) AS t FROM range(9) a(j), range(48) b(x)
  WHERE x >= floor((j + 0.5::DOUBLE) * 48 / 9 - 16 + 0.5::DOUBLE) AND x < floor((j + 0.5::DOUBLE) * 48 / 9 + 16 + 0.5::DOUBLE)),
wx AS (SELECT j, x, {LANCZOS.format(t="t")} AS w FROM tx),
across AS (SELECT item_id, height, y, j, {WHOLE.format(v="sum(w * l) / sum(w)")} AS v FROM luma JOIN wx USING (x) GROUP BY item_id, height, y, j),
sizes AS (SELECT DISTINCT height, height / 8.0::DOUBLE AS s, greatest(height / 8.0::DOUBLE, 1) AS f FROM padded),
ty AS (SELECT height, i, y, (y + 0.5::DOUBLE - (i + 0.5::DOUBLE) * s) / f AS t FROM (SELECT *, unnest(range(height)) AS y FROM sizes, range(8) a(i))
  WHERE y >= floor((i + 0.5::DOUBLE) * s - 3 * f + 0.5::DOUBLE) AND y < floor((i + 0.5::DOUBLE) * s + 3 * f + 0.5::DOUBLE)),
wy AS (SELECT height, i, y, {LANCZOS.format(t="t")} AS w FROM ty),
cell AS (SELECT item_id, i, j, {WHOLE.format(v="sum(w * v) / sum(w)")} AS v FROM across JOIN wy USING (height, y) GROUP BY item_id, i, j),
bit AS (SELECT item_id, 8 * i + j AS k, v > lead(v) OVER (PARTITION BY item_id, i ORDER BY j) AS up, j FROM cell)""") + r"""
SELECT item_id, string_agg(CASE WHEN up THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM bit WHERE j < 8 GROUP BY item_id""")
def image_dhash_lanczos(spark, d):
    """Difference hashes after resizing by a three-lobed windowed sinc."""
    found = px.pixel_features(t.text_images(spark, d), "hash", resample="lanczos")
    return found.select("item_id", F.lpad(F.bin("dhash"), 64, "0").alias("bits"))


@query("image_hashes", with_views(ITEMS, PIXELS, r"""
rows_ AS (SELECT item_id, i, x, sum(greatest(0, least((i + 1) * height / 16.0::DOUBLE, y + 1) - greatest(i * height / 16.0::DOUBLE, y)) * 16 / height * l) AS v FROM luma, range(16) f(i) GROUP BY item_id, i, x),
cell AS (SELECT item_id, i, x // 3 AS j, sum(v) / 3 AS v FROM rows_ GROUP BY item_id, i, x // 3),
lap AS (SELECT item_id, coalesce(lag(v) OVER rw, 0) + coalesce(lead(v) OVER rw, 0) + coalesce(lag(v) OVER cl, 0) + coalesce(lead(v) OVER cl, 0) - 4 * v AS e
  FROM cell WINDOW rw AS (PARTITION BY item_id, i ORDER BY j), cl AS (PARTITION BY item_id, j ORDER BY i))""") + r"""
SELECT item_id, round(var_pop(e), 3) AS blur_score, var_pop(e) < 50 AS is_blurry FROM lap GROUP BY item_id""")
def image_hashes(spark, d):
    """Blur of every image at a side of 16 pixels."""
    found = px.pixel_features(t.text_images(spark, d), "blur", side=16)
    return found.select("item_id", F.round("blur_score", 3).alias("blur_score"), sc.is_blurry(F.col("blur_score")).alias("is_blurry"))


@query("forensic_verdicts")
def forensic_verdicts(spark, d):
    signals = px.pixel_features(t.text_images(spark, d), "forensics")
    names = ("high_freq_ratio", "low_var_ratio", "peak_ratio", "edge_ratio", "block_ratio", "symmetry_diff")
    found = sc.heuristic_score({n: F.col(n) for n in names})
    return signals.withColumn("h", found).select(
        "item_id", *[F.round(n, 6).alias(n) for n in names], "h.score", F.array_join("h.signals", "; ").alias("signals"),
        sc.risk_verdict(F.col("h.score"))["verdict"].alias("verdict"))


@query("laplacian_residual", with_views(ITEMS, PIXELS, r"""
ch AS (SELECT item_id, 'r' AS c, x, y, r AS v FROM px UNION ALL SELECT item_id, 'g', x, y, g FROM px UNION ALL SELECT item_id, 'b', x, y, b FROM px),
res AS (SELECT item_id, v / 255.0::DOUBLE AS v, (4 * v - coalesce(lag(v) OVER rw, 0) - coalesce(lead(v) OVER rw, 0) - coalesce(lag(v) OVER cl, 0) - coalesce(lead(v) OVER cl, 0)) / 255.0::DOUBLE AS e
  FROM ch WINDOW rw AS (PARTITION BY item_id, c, y ORDER BY x), cl AS (PARTITION BY item_id, c, x ORDER BY y))""") + r"""
SELECT item_id, round(avg(abs(e)), 4) AS residual_abs_mean, round(stddev_pop(e), 4) AS residual_std, round(avg(v + 0.3::DOUBLE * e), 4) AS boosted_mean, round(stddev_pop(v + 0.3::DOUBLE * e), 4) AS boosted_std
FROM res GROUP BY item_id""")
def laplacian_residual(spark, d):
    found = px.pixel_features(t.text_images(spark, d), "residual")
    return found.select("item_id", *[F.round(c, 4).alias(c) for c in ("residual_abs_mean", "residual_std", "boosted_mean", "boosted_std")])


@query("feature_vectors", with_views(ITEMS, PIXELS, r"""
ch AS (SELECT item_id, height, x, y, 0 AS c, r AS v FROM px UNION ALL SELECT item_id, height, x, y, 1, g FROM px UNION ALL SELECT item_id, height, x, y, 2, b FROM px),
rows_ AS (SELECT item_id, c, i, x, sum(greatest(0, least((i + 1) * height / 8.0::DOUBLE, y + 1) - greatest(i * height / 8.0::DOUBLE, y)) * 8 / height * v) AS v FROM ch, range(8) f(i) GROUP BY item_id, c, i, x),
cell AS (SELECT item_id, c, i, j, sum(v) / 6 AS v FROM rows_, range(8) f(j) WHERE x // 6 = j GROUP BY item_id, c, i, j),
vec AS (SELECT item_id, (v / 255 - [0.485, 0.456, 0.406][c + 1]::DOUBLE) / [0.229, 0.224, 0.225][c + 1]::DOUBLE AS v FROM cell)""") + r"""
SELECT item_id, CAST(count(*) AS INTEGER) AS size, round(min(v), 3) AS smallest, round(max(v), 3) AS largest FROM vec GROUP BY item_id""")
def feature_vectors(spark, d):
    """Size and range of every normalised vector; the vectors themselves are what the operator returns."""
    found = px.feature_vectors(t.text_images(spark, d), 8)
    wide = F.transform("vector", lambda x: x.cast("double"))
    return found.select("item_id", F.size("vector").alias("size"), F.round(F.array_min(wide), 3).alias("smallest"), F.round(F.array_max(wide), 3).alias("largest"))


@query("augment_images")
def augment_images(spark, d):
    return px.augment(t.text_images(spark, d), 3).select("item_id", "kind", "height", "width", F.md5("data").alias("pixels_md5"))


ARTIFACT_METRICS = [name for _, name, _, _ in inv.FAILURE_RULES if name != "brightness"] + ["brightness"]


@query("false_positive_artifacts", with_views(ITEMS, ARTIFACTS, PREDICTIONS, f"o AS (SELECT a.*, {OUTCOME} AS outcome FROM art a JOIN predictions p USING (item_id))",
    "l AS (" + " UNION ALL ".join(f"SELECT outcome, '{c}' AS metric, {c}::DOUBLE AS v FROM o" for c in dict.fromkeys(ARTIFACT_METRICS)) + ")", COHORTS) + COHORT_ROWS)
def false_positive_artifacts(spark, d):
    """Artifact features of false positives against true negatives."""
    rows = t.predictions(spark, d).select("item_id", "label", "p_micro")
    found = px.pixel_features(t.text_images(spark, d), "artifacts").join(rows, "item_id")
    return inv.compare_cohorts(inv.with_outcome(found, 0.52), list(dict.fromkeys(ARTIFACT_METRICS)))


# --- stream ------------------------------------------------------------------

@query("score_stream", r"""
WITH s AS (SELECT event_id AS item_id, event_type, least(greatest(least(value / 100, 1.0::DOUBLE), 1e-6::DOUBLE), (1.0::DOUBLE - 1e-6::DOUBLE)) AS q FROM events),
p AS (SELECT item_id, event_type, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-ln(q / (1.0::DOUBLE - q)))), 6) AS p, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-ln(q / (1.0::DOUBLE - q)))) * 100, 4) AS points FROM s)
SELECT item_id, event_type, p,
  CASE WHEN p >= 0.52::DOUBLE AND p > 0.8::DOUBLE THEN 'LIKELY DEEPFAKE' WHEN p >= 0.52::DOUBLE AND p > 0.6::DOUBLE THEN 'POSSIBLY DEEPFAKE' WHEN p < 0.52::DOUBLE AND 1.0::DOUBLE - p > 0.6::DOUBLE THEN 'LIKELY AUTHENTIC' ELSE 'INCONCLUSIVE' END AS verdict,
  CASE WHEN points >= 85 THEN 'LIKELY DEEPFAKE' WHEN points >= 55 THEN 'POSSIBLY DEEPFAKE' WHEN points >= 40 THEN 'INCONCLUSIVE' ELSE 'LIKELY AUTHENTIC' END AS risk_verdict,
  CASE WHEN points > 70 THEN 'danger' WHEN points >= 40 THEN 'warning' ELSE 'safe' END AS band FROM p""")
def score_stream(spark, d):
    sink = scratch_path(spark, "scored")
    scoring.score_stream(scoring.read_events(spark, d), sink, scratch_path(spark, "scored-state")).awaitTermination()
    return spark.read.parquet(sink)
