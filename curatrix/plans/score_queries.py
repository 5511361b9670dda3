"""Metrics, curves, label quality and calibration over the scored items."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.operators import calibration as cal
from curatrix.operators import investigate as inv
from curatrix.operators import isotonic as iso
from curatrix.operators import labels as lb
from curatrix.operators import metrics as m
from curatrix.operators import profile as pr
from curatrix.plans.oracle_views import ITEMS, METRICS, PREDICTIONS, with_views
from curatrix.plans.registry import query
from curatrix.session import materialize
from curatrix.sources import tables as t

def scored(spark, d, *columns):
    """The scores written once, as a saved prediction table: no later filter reaches back into the text."""
    return materialize(t.predictions(spark, d).select(*columns), "predictions")


# Metrics from tp, fp, tn, fn in SQL.
RATES = """
round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + tn + fn) ELSE 0 END, 6) AS accuracy,
round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS "precision",
round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 6) AS fpr,
round(CASE WHEN fn + tp > 0 THEN fn::DOUBLE / (fn + tp) ELSE 0 END, 6) AS fnr"""


def cells(test: str, label: str = "label") -> str:
    return f"""count(*) FILTER (WHERE {label} = 1 AND {test}) AS tp, count(*) FILTER (WHERE {label} = 0 AND {test}) AS fp,
       count(*) FILTER (WHERE {label} = 0 AND NOT ({test})) AS tn, count(*) FILTER (WHERE {label} = 1 AND NOT ({test})) AS fn"""


def sweep(name: str, grid: m.Grid, label: str = "label", source: str = "predictions", score: str = "p_micro") -> str:
    test = f"{score} * {grid.scale} >= ({grid.start} + {grid.step} * k) * 1000000"
    return f"""
{name}_cells AS (SELECT k, {cells(test, label)} FROM {source}, range({grid.size}) g(k) GROUP BY k),
{name} AS (SELECT CAST(k AS INTEGER) AS k, round(({grid.start} + {grid.step} * k) / {grid.scale}.0::DOUBLE, 6) AS threshold, tp, fp, tn, fn, {RATES} FROM {name}_cells)"""


ALL = 'threshold, accuracy, "precision", recall, f1, fpr, fnr, tp, fp, tn, fn'


@query("predictions_view", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, split, class, label, label_q, label_any, p_base, p_hn, p_ens, p_micro, round(logit, 6) AS logit FROM predictions")
def predictions_view(spark, d):
    return t.predictions(spark, d).withColumn("logit", F.round("logit", 6))


@query("confusion", with_views(ITEMS, PREDICTIONS, f"c AS (SELECT {cells('p_micro >= 520000')} FROM predictions)") + f"SELECT tp, fp, tn, fn, {RATES} FROM c")
def confusion(spark, d):
    return m.confusion(t.predictions(spark, d), 0.52)


@query("confusion_by_split", with_views(ITEMS, PREDICTIONS, f"c AS (SELECT split, {cells('p_micro >= 500000', 'label_q')} FROM predictions GROUP BY split)")
       + f"SELECT split, tp, fp, tn, fn, {RATES} FROM c")
def confusion_by_split(spark, d):
    return m.confusion(t.predictions(spark, d), 0.50, "label_q", by=["split"])


@query("threshold_sweep", with_views(ITEMS, PREDICTIONS, sweep("s", m.PUBLISHED)) + "SELECT * FROM s")
def threshold_sweep(spark, d):
    return m.threshold_sweep(t.predictions(spark, d))


LINES = "SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label, CAST(round(least(l_extendedprice / 105000, 1.0::DOUBLE) * 1000000) AS BIGINT) AS p_micro FROM lineitem"


def line_scores(spark, d):
    """A large scored table: returned lines as the positive class, price as the score."""
    return t.table(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        t.micro(F.least(F.col("l_extendedprice") / 105000, F.lit(1.0))).alias("p_micro"))


@query("threshold_sweep_lines", f"WITH predictions AS ({LINES})," + sweep("s", m.PUBLISHED) + "SELECT * FROM s")
def threshold_sweep_lines(spark, d):
    return m.threshold_sweep(line_scores(spark, d))


@query("roc_auc_lines", f"""WITH predictions AS ({LINES}),
f AS (SELECT p_micro, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM predictions GROUP BY p_micro),
w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY p_micro DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM f)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(neg * (2 * above + pos))::DOUBLE / (2.0::DOUBLE * sum(pos) * sum(neg)), 6) AS auc FROM w""")
def roc_auc_lines(spark, d):
    return m.roc_auc(line_scores(spark, d))


@query("best_threshold", with_views(ITEMS, PREDICTIONS, sweep("s", m.PUBLISHED, "label_q")) + f"SELECT {ALL} FROM s ORDER BY round(f1, 5) DESC, k LIMIT 1")
def best_threshold(spark, d):
    return m.best_threshold(m.threshold_sweep(t.predictions(spark, d), label="label_q")).drop("k")


@query("best_threshold_capped", with_views(ITEMS, PREDICTIONS, sweep("s", m.CALIBRATION)) + f"SELECT {ALL} FROM s WHERE fpr <= 0.05 ORDER BY round(f1, 5) DESC, k LIMIT 1")
def best_threshold_capped(spark, d):
    return m.best_threshold(m.threshold_sweep(t.predictions(spark, d), m.CALIBRATION), 0.05).drop("k")


@query("roc_curve", with_views(ITEMS, PREDICTIONS, sweep("s", m.ROC_GRID)) + "SELECT k, threshold, recall AS tpr, fpr FROM s")
def roc_curve(spark, d):
    return m.roc_curve(t.predictions(spark, d))


@query("grid_auc", with_views(ITEMS, PREDICTIONS, sweep("s", m.ROC_GRID), """
pts AS (SELECT k, fp::DOUBLE / (fp + tn) AS x, tp::DOUBLE / (tp + fn) AS y FROM s),
seg AS (SELECT (x - lag(x) OVER (ORDER BY k)) * (y + lag(y) OVER (ORDER BY k)) / 2 AS a FROM pts)""") + "SELECT round(abs(sum(a)), 6) AS auc FROM seg")
def grid_auc(spark, d):
    return m.grid_auc(t.predictions(spark, d))


@query("roc_auc", with_views(ITEMS, PREDICTIONS) + r"""
SELECT (SELECT count(*) FROM predictions WHERE label = 1) AS n_pos, (SELECT count(*) FROM predictions WHERE label = 0) AS n_neg,
  round(avg(CASE WHEN a.p_micro > b.p_micro THEN 1.0::DOUBLE WHEN a.p_micro = b.p_micro THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc
FROM predictions a JOIN predictions b ON a.label = 1 AND b.label = 0""")
def roc_auc(spark, d):
    return m.roc_auc(scored(spark, d, "label", "p_micro"))


@query("pr_curve", with_views(ITEMS, PREDICTIONS, sweep("s", m.PR_GRID)) + 'SELECT k, threshold, "precision", recall FROM s')
def pr_curve(spark, d):
    return m.pr_curve(t.predictions(spark, d))


@query("sweep_series", with_views(ITEMS, PREDICTIONS, sweep("s", m.PUBLISHED)) + r"""
SELECT threshold, f1, fpr, recall, row_number() OVER (ORDER BY round(f1, 5) DESC, k) = 1 AS is_best FROM s""")
def sweep_series(spark, d):
    return m.sweep_series(m.threshold_sweep(t.predictions(spark, d)))


@query("score_histogram", with_views(ITEMS, PREDICTIONS, r"""
cnt AS (SELECT label, CAST(least(floor(p_micro / 1e6::DOUBLE * 80), 79) AS INTEGER) AS bin, count(*) AS n FROM predictions GROUP BY 1, 2),
tot AS (SELECT label, sum(n) AS total FROM cnt GROUP BY label)""") + r"""
SELECT t.label, CAST(r.bin AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, round(r.bin * (1.0::DOUBLE / 80), 6) AS lower, round((r.bin + 1) * (1.0::DOUBLE / 80), 6) AS upper,
       round(coalesce(n, 0)::DOUBLE / (total * (1.0::DOUBLE / 80)), 6) AS density
FROM tot t CROSS JOIN range(80) r(bin) LEFT JOIN cnt c ON c.label = t.label AND c.bin = r.bin""")
def score_histogram(spark, d):
    rows = scored(spark, d, "label", (F.col("p_micro") / 1e6).alias("p"))
    return pr.histogram(rows, "p", 80, 0.0, 1.0, by=["label"], density=True)


# --- label quality -----------------------------------------------------------

@query("exclude_items", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, split FROM items WHERE item_id NOT IN (SELECT item_id FROM predictions)")
def exclude_items(spark, d):
    return lb.exclude(t.items(spark, d).select("item_id", "split"), t.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")))


@query("existing_edges", r"""
WITH e AS (SELECT event_id AS edge_id, user_id AS id_a, event_id % 1200 AS id_b FROM events)
SELECT edge_id, id_a, id_b FROM e WHERE id_a IN (SELECT doc_id FROM labels) AND id_b IN (SELECT doc_id FROM labels)""")
def existing_edges(spark, d):
    edges = t.table(spark, d, "events").select(F.col("event_id").alias("edge_id"), F.col("user_id").alias("id_a"), (F.col("event_id") % 1200).alias("id_b"))
    return lb.existing_only(edges, t.table(spark, d, "labels").select(F.col("doc_id").alias("item_id")))


FLIPS = "flips AS (SELECT item_id, 1 - label AS corrected FROM predictions WHERE (label = 1 AND p_micro < 100000) OR (label = 0 AND p_micro > 900000))"


def flips_of(rows):
    return lb.mislabel_candidates(rows).select("item_id", (1 - F.col("label")).alias("corrected"))


@query("apply_corrections", with_views(ITEMS, PREDICTIONS, FLIPS) + r"""
SELECT item_id, label, coalesce(f.corrected, label) AS corrected FROM predictions LEFT JOIN flips f USING (item_id)""")
def apply_corrections(spark, d):
    rows = scored(spark, d, "item_id", "label", "p_micro")
    return lb.apply_corrections(rows.select("item_id", "label"), flips_of(rows))


@query("ensemble_mean", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, p_base AS p_a, p_hn AS p_b, (p_base + p_hn) / 2 AS p_ens FROM predictions")
def ensemble_mean(spark, d):
    both = scored(spark, d, "item_id", "p_base", "p_hn")
    return lb.ensemble(both.select("item_id", F.col("p_base").alias("p")), both.select("item_id", F.col("p_hn").alias("p")))


@query("merge_verdicts", with_views(ITEMS, PREDICTIONS, r"""
own AS (SELECT item_id, p_base >= 0.52::DOUBLE AS is_fake, round((CASE WHEN p_base >= 0.52::DOUBLE THEN p_base ELSE 1.0::DOUBLE - p_base END) * 100, 1) AS conf, round(p_base * 100, 1) AS risk,
  CASE WHEN p_base >= 0.52::DOUBLE AND p_base > 0.8::DOUBLE THEN 'LIKELY DEEPFAKE' WHEN p_base >= 0.52::DOUBLE AND p_base > 0.6::DOUBLE THEN 'POSSIBLY DEEPFAKE'
       WHEN p_base < 0.52::DOUBLE AND 1.0::DOUBLE - p_base > 0.6::DOUBLE THEN 'LIKELY AUTHENTIC' ELSE 'INCONCLUSIVE' END AS verdict FROM predictions),
second AS (SELECT item_id, 'INCONCLUSIVE' AS verdict, (file_size % 101)::DOUBLE AS risk_score, (file_size % 97)::DOUBLE AS confidence, split AS summary FROM items)""") + r"""
SELECT s.item_id,
  CASE WHEN o.is_fake IS NULL THEN s.verdict WHEN o.is_fake THEN CASE WHEN o.conf >= 85 THEN 'LIKELY DEEPFAKE' ELSE 'POSSIBLY DEEPFAKE' END
       ELSE CASE WHEN o.conf >= 75 THEN 'LIKELY AUTHENTIC' ELSE 'INCONCLUSIVE' END END AS verdict,
  CASE WHEN o.is_fake IS NULL THEN s.risk_score WHEN o.is_fake THEN greatest(s.risk_score, o.risk) ELSE least(s.risk_score, o.risk) END AS risk_score,
  CASE WHEN o.is_fake IS NULL THEN s.confidence ELSE greatest(s.confidence, o.conf) END AS confidence,
  CASE WHEN o.is_fake IS NULL THEN s.summary ELSE '[model: ' || o.verdict || ' at ' || CAST(o.conf AS VARCHAR) || '%] ' || s.summary END AS summary
FROM second s LEFT JOIN own o USING (item_id)""")
def merge_verdicts(spark, d):
    model = t.predictions(spark, d).select("item_id", sc.calibrated_verdict(F.col("p_base"), 0.52).alias("v")).select("item_id", "v.*")
    second = t.items(spark, d).select(
        "item_id", F.lit("INCONCLUSIVE").alias("verdict"), (F.col("file_size") % 101).cast("double").alias("risk_score"),
        (F.col("file_size") % 97).cast("double").alias("confidence"), F.col("split").alias("summary"))
    return lb.merge_verdicts(model, second)


@query("ambiguous_items", with_views(ITEMS, PREDICTIONS) + "SELECT item_id, label, p_micro FROM predictions WHERE p_micro BETWEEN 350000 AND 650000")
def ambiguous_items(spark, d):
    return lb.ambiguous(scored(spark, d, "item_id", "label", "p_micro"))


@query("boundary_report", with_views(ITEMS, PREDICTIONS) + r"""
SELECT CASE WHEN label = 1 THEN 'Fake' ELSE 'Real' END AS class_name, count(*) FILTER (WHERE p_micro BETWEEN 350000 AND 650000) AS n_ambiguous, count(*) AS n_total,
       round(count(*) FILTER (WHERE p_micro BETWEEN 350000 AND 650000)::DOUBLE / count(*), 6) AS share FROM predictions GROUP BY 1""")
def boundary_report(spark, d):
    return lb.boundary_report(t.predictions(spark, d))


@query("class_overlap", with_views(ITEMS, PREDICTIONS, r"""
h AS (SELECT CAST(least(floor(p_micro / 1e6::DOUBLE * 20), 19) AS INTEGER) AS bin, count(*) FILTER (WHERE label = 1) AS a, count(*) FILTER (WHERE label = 0) AS b FROM predictions GROUP BY 1)""") + r"""
SELECT round(sum(least(a::DOUBLE / (SELECT sum(a) FROM h), b::DOUBLE / (SELECT sum(b) FROM h))), 6) AS overlap FROM h""")
def class_overlap(spark, d):
    return lb.class_overlap(scored(spark, d, "label", "p_micro"))


@query("mislabel_candidates", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, label, p_micro, abs(p_micro - label * 1000000) AS disagreement FROM predictions
WHERE (label = 1 AND p_micro < 100000) OR (label = 0 AND p_micro > 900000)""")
def mislabel_candidates(spark, d):
    return lb.mislabel_candidates(scored(spark, d, "item_id", "label", "p_micro")).select("item_id", "label", "p_micro", "disagreement")


@query("average_passes", with_views(ITEMS, PREDICTIONS, r"""
avgd AS (SELECT item_id, label, CAST(floor((CAST(round(p_base * 1e6::DOUBLE) AS BIGINT) + CAST(round(p_hn * 1e6::DOUBLE) AS BIGINT) + p_micro) / 3.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS p_micro FROM predictions)""",
    sweep("s", m.AVERAGED, source="avgd")) + f"SELECT {ALL} FROM s ORDER BY round(f1, 5) DESC, k LIMIT 1")
def average_passes(spark, d):
    passes = t.predictions(spark, d).select("item_id", "label", F.explode(F.array(
        t.micro(F.col("p_base")), t.micro(F.col("p_hn")), F.col("p_micro"))).alias("p_micro"))
    return m.best_threshold(m.threshold_sweep(lb.average_passes(passes), m.AVERAGED)).drop("k")


@query("losses", with_views(ITEMS, PREDICTIONS, r"""
z AS (SELECT label AS y, logit AS z, 1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)) AS p, greatest(logit, 0.0::DOUBLE) + ln(1.0::DOUBLE + exp(-abs(logit))) AS base, label * 0.9::DOUBLE + 0.05::DOUBLE AS ys FROM predictions),
q AS (SELECT *, power(1.0::DOUBLE - CASE WHEN y = 1 THEN p ELSE 1.0::DOUBLE - p END, 2.0::DOUBLE) AS fw FROM z)""") + r"""
SELECT round(avg(base - z * y), 6) AS log_loss, round(avg(0.25::DOUBLE * fw * (base - z * y)), 6) AS focal_loss, round(avg(fw * (base - z * ys)), 6) AS focal_smoothed,
       round(avg(CASE WHEN y = 1 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END * fw * (base - z * ys)), 6) AS focal_by_class,
       round(avg(base - z * CASE WHEN y = 1 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END), 6) AS smoothed_bce FROM q""")
def losses(spark, d):
    return m.losses(t.predictions(spark, d))


@query("flip_report", with_views(ITEMS, PREDICTIONS, FLIPS, "fixed AS (SELECT p_micro, label, coalesce(f.corrected, label) AS corrected FROM predictions LEFT JOIN flips f USING (item_id))",
    f"both_ AS (SELECT 'stored' AS labels, {cells('p_micro >= 520000')} FROM fixed UNION ALL SELECT 'corrected', {cells('p_micro >= 520000', 'corrected')} FROM fixed)")
    + f"SELECT labels, tp, fp, tn, fn, {RATES} FROM both_")
def flip_report(spark, d):
    rows = scored(spark, d, "item_id", "label", "p_micro")
    return lb.flip_report(lb.apply_corrections(rows, flips_of(rows)), 0.52)


# --- error analysis ----------------------------------------------------------

COHORT_METRICS = ("brightness", "blur_score", "pixel_std", "width", "height", "file_size")
OUTCOME = "CASE WHEN label = 1 AND p_micro >= 520000 THEN 'TP' WHEN label = 1 THEN 'FN' WHEN p_micro >= 520000 THEN 'FP' ELSE 'TN' END"
SCORED_METRICS = PREDICTIONS[PREDICTIONS.index("scored AS"):]


COHORTS = "st AS (SELECT metric, avg(v) FILTER (WHERE outcome = 'FP') AS a, stddev_pop(v) FILTER (WHERE outcome = 'FP') AS sa, avg(v) FILTER (WHERE outcome = 'TN') AS b, stddev_pop(v) FILTER (WHERE outcome = 'TN') AS sb FROM l GROUP BY metric)"
COHORT_ROWS = r"""
SELECT metric, round(a, 3) AS fp_mean, round(sa, 3) AS fp_std, round(b, 3) AS tn_mean, round(sb, 3) AS tn_std, round(a - b, 3) AS delta,
       round(abs(a - b) / greatest(abs(b), 1e-6::DOUBLE) * 100, 1) AS pct_diff, abs(a - b) / greatest(abs(b), 1e-6::DOUBLE) * 100 > 15 AS flagged FROM st WHERE a - b IS NOT NULL"""


@query("compare_cohorts", with_views(ITEMS, METRICS, SCORED_METRICS, f"o AS (SELECT m.*, {OUTCOME} AS outcome FROM metrics m JOIN predictions p USING (item_id))",
    "l AS (" + " UNION ALL ".join(f"SELECT outcome, '{c}' AS metric, {c}::DOUBLE AS v FROM o" for c in COHORT_METRICS) + ")",
    COHORTS) + COHORT_ROWS)
def compare_cohorts(spark, d):
    rows = scored(spark, d, "item_id", "label", "p_micro")
    joined = materialize(t.item_metrics(spark, d).select("item_id", *COHORT_METRICS), "metrics").join(rows, "item_id")
    return inv.compare_cohorts(inv.with_outcome(joined, 0.52), COHORT_METRICS)


@query("confidence_bins", with_views(ITEMS, PREDICTIONS, r"""
edges(bin, confidence, lo, hi) AS (VALUES (0, '0.50-0.55', 500000, 550000), (1, '0.55-0.60', 550000, 600000), (2, '0.60-0.65', 600000, 650000), (3, '0.65-0.70', 650000, 700000),
 (4, '0.70-0.75', 700000, 750000), (5, '0.75-0.80', 750000, 800000), (6, '0.80-0.85', 800000, 850000), (7, '0.85-0.90', 850000, 900000), (8, '0.90-1.00', 900000, 1000001))""") + r"""
SELECT bin, confidence, count(p.item_id) AS n FROM edges e LEFT JOIN predictions p ON p.label = 0 AND p.p_micro >= 500000 AND p.p_micro >= e.lo AND p.p_micro < e.hi GROUP BY bin, confidence""")
def confidence_bins(spark, d):
    return inv.confidence_bins(scored(spark, d, "label", "p_micro").where("label = 0 and p_micro >= 500000"))


@query("failure_patterns", with_views(ITEMS, METRICS, r"""
art AS (SELECT blur_score AS laplacian_var, pixel_std * 8 AS skin_smoothness_std, brightness / 4 AS contrast, width::DOUBLE AS avg_dct_energy, aspect_ratio AS edge_density_pct,
  pixel_std AS noise_level, brightness AS saturation, brightness, file_size / 1024.0::DOUBLE AS file_size_kb FROM metrics)""") + "UNION ALL ".join(f"""
SELECT '{n}' AS pattern, count(*) FILTER (WHERE {c} {s} {x}) AS n_items, round(100.0::DOUBLE * count(*) FILTER (WHERE {c} {s} {x}) / count(*), 1) AS percent FROM art
""" for n, c, s, x in inv.FAILURE_RULES))
def failure_patterns(spark, d):
    c = F.col
    return inv.failure_patterns(t.item_metrics(spark, d).select(
        c("blur_score").alias("laplacian_var"), (c("pixel_std") * 8).alias("skin_smoothness_std"), (c("brightness") / 4).alias("contrast"),
        c("width").cast("double").alias("avg_dct_energy"), c("aspect_ratio").alias("edge_density_pct"), c("pixel_std").alias("noise_level"),
        c("brightness").alias("saturation"), "brightness", (c("file_size") / 1024).alias("file_size_kb")))


MAPS = r"""WITH cells AS (SELECT vec_id, label, i - 1 AS pos, abs(embedding[i])::DOUBLE AS v FROM embeddings, range(1, 65) g(i)),
reg AS (SELECT vec_id, any_value(CASE WHEN label < 5 THEN 'FP' ELSE 'TN' END) AS outcome,
  round(sum(v) FILTER (WHERE pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5) / (sum(v) + 1e-8::DOUBLE) * 100, 1) AS center_pct,
  round(sum(v) FILTER (WHERE (pos // 8 < 2 OR pos // 8 > 5) AND (pos % 8 < 2 OR pos % 8 > 5)) / (sum(v) + 1e-8::DOUBLE) * 100, 1) AS corner_pct,
  round(max(v), 4) AS max_activation, round(sum(v) / 64, 4) AS mean_activation FROM cells GROUP BY vec_id)
"""


def attention_maps(spark, d):
    """Embeddings as 8x8 maps of their magnitudes."""
    row = [F.transform(F.slice("embedding", 8 * i + 1, 8), lambda v: F.abs(v.cast("double"))) for i in range(8)]
    return t.table(spark, d, "embeddings").select(
        "vec_id", F.when(F.col("label") < 5, "FP").otherwise("TN").alias("outcome"), F.array(*row).alias("cam"))


@query("attention_regions", MAPS + "SELECT * FROM reg")
def attention_regions(spark, d):
    return inv.attention_regions(attention_maps(spark, d)).drop("cam")


@query("attention_compare", MAPS + r""", mean4 AS (SELECT avg(center_pct) FILTER (WHERE outcome = 'FP') AS fc, avg(center_pct) FILTER (WHERE outcome = 'TN') AS tc,
  avg(corner_pct) FILTER (WHERE outcome = 'FP') AS fk, avg(corner_pct) FILTER (WHERE outcome = 'TN') AS tk FROM reg)
SELECT round(fc, 1) AS fp_center_mean, round(tc, 1) AS tn_center_mean, round(fk, 1) AS fp_corner_mean, round(tk, 1) AS tn_corner_mean,
  CASE WHEN fk > tk + 5 THEN 'corner shortcut' WHEN fc < tc - 10 THEN 'weak center' ELSE 'similar' END AS finding FROM mean4""")
def attention_compare(spark, d):
    return inv.attention_compare(inv.attention_regions(attention_maps(spark, d)))


# --- calibration -------------------------------------------------------------

NEWTON_T = r"""
newton(i, beta) AS (
  SELECT 0, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN beta - s / c > 0 THEN beta - s / c ELSE beta / 2 END FROM (
    SELECT n.i, n.beta, sum(z * (1.0::DOUBLE / (1.0::DOUBLE + exp(-z * n.beta)) - y)) AS s,
           sum(z * z * (1.0::DOUBLE / (1.0::DOUBLE + exp(-z * n.beta))) * (1.0::DOUBLE - 1.0::DOUBLE / (1.0::DOUBLE + exp(-z * n.beta)))) AS c
    FROM newton n, zy WHERE n.i < 25 GROUP BY n.i, n.beta))"""

NEWTON_WB = r"""
platt(i, w, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) FROM (
    SELECT i, w, b, sum(z * (p - y)) AS gw, sum(p - y) AS gb, sum(z * z * p * (1 - p)) AS hww, sum(z * p * (1 - p)) AS hwb, sum(p * (1 - p)) AS hbb FROM (
      SELECT n.i, n.w, n.b, z, y, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(z * n.w + n.b))) AS p FROM platt n, zy WHERE n.i < 25) GROUP BY i, w, b))"""

ISO = r"""
pooled AS (SELECT p_micro, avg(label_any::DOUBLE) AS y, count(*) AS w, row_number() OVER (ORDER BY p_micro) AS r FROM predictions GROUP BY p_micro),
pre AS (SELECT p_micro, r, sum(y * w) OVER (ORDER BY r) AS sy, sum(w) OVER (ORDER BY r) AS sw FROM pooled),
spans AS (SELECT j.r AS j, k.r AS k, (k.sy - coalesce(b.sy, 0)) / (k.sw - coalesce(b.sw, 0)) AS a FROM pre j JOIN pre k ON k.r >= j.r LEFT JOIN pre b ON b.r = j.r - 1),
lows AS (SELECT j, k, min(a) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS lo FROM spans),
iso AS (SELECT p.p_micro, max(l.lo) AS p_iso FROM pre p JOIN lows l ON l.k = p.r AND l.j <= p.r GROUP BY p.p_micro)"""


@query("fit_temperature", with_views(ITEMS, PREDICTIONS, "zy AS (SELECT logit AS z, label_any::DOUBLE AS y FROM predictions)", NEWTON_T)
       + "SELECT round(1.0::DOUBLE / beta, 5) AS temperature FROM newton ORDER BY i DESC LIMIT 1")
def fit_temperature(spark, d):
    temperature = cal.fit_temperature(t.predictions(spark, d), label="label_any")
    return spark.range(1).select(F.round(F.lit(temperature), 5).alias("temperature"))


@query("fit_platt", with_views(ITEMS, PREDICTIONS, "zy AS (SELECT logit AS z, label_any::DOUBLE AS y FROM predictions)", NEWTON_WB)
       + "SELECT round(w, 3) AS platt_w, round(b, 3) AS platt_b FROM platt ORDER BY i DESC LIMIT 1")
def fit_platt(spark, d):
    slope, intercept = cal.fit_platt(t.predictions(spark, d), label="label_any")
    return spark.range(1).select(F.round(F.lit(slope), 3).alias("platt_w"), F.round(F.lit(intercept), 3).alias("platt_b"))


@query("fit_isotonic", with_views(ITEMS, PREDICTIONS, ISO) + r"""
SELECT item_id, p.p_micro, round(p_iso, 6) AS p_iso FROM predictions p JOIN iso i ON i.p_micro = p.p_micro""")
def fit_isotonic(spark, d):
    rows = scored(spark, d, "item_id", "label_any", "p_micro")
    model = cal.fit_isotonic(rows, label="label_any")
    return cal.apply_isotonic(model, rows.select("item_id", "p_micro")).select("item_id", "p_micro", F.round("p_iso", 6).alias("p_iso"))


@query("isotonic_transfer", with_views(ITEMS, PREDICTIONS, ISO.replace("FROM predictions", "FROM (SELECT p_ens AS p_micro, label_any FROM predictions WHERE split = 'Validation')"), r"""
steps AS (SELECT p_micro AS z, p_iso, lead(p_micro) OVER o AS next_z, lead(p_iso) OVER o AS next_p FROM iso WINDOW o AS (ORDER BY p_micro))""") + r"""
SELECT item_id, round(CASE WHEN z IS NULL THEN (SELECT min(p_iso) FROM iso) ELSE p_iso + coalesce((p_ens - z) / (next_z - z) * (next_p - p_iso), 0) END, 6) AS p_iso
FROM predictions p ASOF LEFT JOIN steps s ON p.p_ens >= s.z""")
def isotonic_transfer(spark, d):
    """Fitted on the raw scores of Validation, applied to every item: between blocks on a line, beyond the ends flat."""
    rows = scored(spark, d, "item_id", "split", "label_any", "p_ens")
    blocks = iso.fit(rows.where("split = 'Validation'"), "p_ens", "label_any")
    return iso.apply(blocks, rows, "p_ens").select("item_id", F.round("p_iso", 6).alias("p_iso"))


def _best(name: str, source: str) -> str:
    return sweep(name, m.CALIBRATION, "label_any", source)


@query("calibration_recommendations", with_views(ITEMS, PREDICTIONS, "zy AS (SELECT logit AS z, label_any::DOUBLE AS y FROM predictions)", NEWTON_T, NEWTON_WB, ISO, r"""
tt AS (SELECT beta FROM newton ORDER BY i DESC LIMIT 1), wb AS (SELECT w, b FROM platt ORDER BY i DESC LIMIT 1),
sc_t AS (SELECT label_any, CAST(round(1e6::DOUBLE / (1.0::DOUBLE + exp(-logit * beta))) AS BIGINT) AS p_micro FROM predictions, tt),
sc_p AS (SELECT label_any, CAST(round(1e6::DOUBLE / (1.0::DOUBLE + exp(-(logit * w + b)))) AS BIGINT) AS p_micro FROM predictions, wb),
sc_i AS (SELECT label_any, CAST(round(p_iso * 1e6::DOUBLE) AS BIGINT) AS p_micro FROM predictions p JOIN iso i ON i.p_micro = p.p_micro)""",
    _best("su", "predictions"), _best("st", "sc_t"), _best("sp", "sc_p"), _best("si", "sc_i"),
    f"now_c AS (SELECT {cells('p_micro >= 520000', 'label_any')} FROM predictions)")
    + f"SELECT 'in use' AS method, {ALL} FROM (SELECT 0.52::DOUBLE AS threshold, tp, fp, tn, fn, {RATES} FROM now_c)"
    + "".join(f" UNION ALL SELECT * FROM (SELECT '{n}' AS method, {ALL} FROM {s} ORDER BY round(f1, 5) DESC, k LIMIT 1)"
              for n, s in (("uncalibrated", "su"), ("temperature", "st"), ("platt", "sp"), ("isotonic", "si"))))
def calibration_recommendations(spark, d):
    return cal.calibration_recommendations(scored(spark, d, "label_any", "logit", "p_micro"), label="label_any")


@query("honest_eval", with_views(ITEMS, PREDICTIONS, r"""
zy AS (SELECT logit AS z, label_any::DOUBLE AS y FROM predictions WHERE split = 'Validation')""", NEWTON_T, r"""
tt AS (SELECT beta FROM newton ORDER BY i DESC LIMIT 1),
flips AS (SELECT item_id, 1 - label_any AS corrected FROM predictions WHERE (label_any = 1 AND p_micro < 100000) OR (label_any = 0 AND p_micro > 900000)),
scaled AS (SELECT p.item_id, split, label_any, coalesce(f.corrected, label_any) AS corrected, CAST(round(1e6::DOUBLE / (1.0::DOUBLE + exp(-logit * beta))) AS BIGINT) AS p_micro
  FROM predictions p LEFT JOIN flips f USING (item_id), tt),
val AS (SELECT * FROM scaled WHERE split = 'Validation'), tst AS (SELECT * FROM scaled WHERE split = 'Test')""", sweep("sv", m.PUBLISHED, "label_any", "val"), f"""
pick AS (SELECT threshold, CAST(round(threshold * 1000000) AS BIGINT) AS cut FROM sv ORDER BY round(f1, 5) DESC, k LIMIT 1),
both_ AS (SELECT 'stored' AS labels, {cells('p_micro >= cut', 'label_any')} FROM tst, pick UNION ALL SELECT 'corrected', {cells('p_micro >= cut', 'corrected')} FROM tst, pick),
auc AS (SELECT 'stored' AS labels, round(avg(CASE WHEN a.p_micro > b.p_micro THEN 1.0::DOUBLE WHEN a.p_micro = b.p_micro THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS auc FROM tst a JOIN tst b ON a.label_any = 1 AND b.label_any = 0
  UNION ALL SELECT 'corrected', round(avg(CASE WHEN a.p_micro > b.p_micro THEN 1.0::DOUBLE WHEN a.p_micro = b.p_micro THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM tst a JOIN tst b ON a.corrected = 1 AND b.corrected = 0)""")
    + f"SELECT labels, tp, fp, tn, fn, {RATES}, auc, (SELECT round(1.0::DOUBLE / beta, 6) FROM tt) AS temperature, (SELECT threshold FROM pick) AS threshold FROM both_ JOIN auc USING (labels)")
def honest_eval(spark, d):
    rows = scored(spark, d, "item_id", "split", "label_any", "logit", "p_micro")
    flips = lb.mislabel_candidates(rows, label="label_any").select("item_id", (1 - F.col("label_any")).alias("corrected"))
    return cal.honest_eval(rows.where("split = 'Validation'"), rows.where("split = 'Test'"), flips, "label_any")
