"""Threshold metrics, sweeps, curves and losses over scored items.

Scores are whole millionths (``p_micro``), so a threshold test is an integer
comparison. A sweep reads the scores once: they are counted per label and grid
cell, and every threshold is a suffix sum over the grid.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix import conventions as cv
from curatrix.operators.skew import running_sums
from curatrix.session import materialize


@dataclass(frozen=True)
class Grid:
    """Thresholds (start + step * k) / scale for k below size; all whole numbers."""

    start: int
    step: int
    scale: int
    size: int

    def value(self, k: Column) -> Column:
        return (F.lit(self.start) + F.lit(self.step) * k) / F.lit(float(self.scale))

    def cell(self, p_micro: Column) -> Column:
        """Index of the last threshold not above the score, -1 if there is none."""
        reach = F.floor((p_micro * self.scale - self.start * cv.MICRO) / (self.step * cv.MICRO))
        return F.greatest(F.least(reach, F.lit(self.size - 1)), F.lit(-1)).cast("int")


PUBLISHED = Grid(30, 1, 100, 62)          # 0.30 .. 0.91
AVERAGED = Grid(25, 1, 100, 60)           # 0.25 .. 0.84
COARSE = Grid(20, 2, 100, 31)             # 0.20 .. 0.80
CALIBRATION = Grid(30, 1, 100, 60)        # 0.30 .. 0.89
ROC_GRID = Grid(0, 1, 499, 500)           # 500 even steps on [0, 1]
PR_GRID = Grid(499, 98, 49900, 500)       # 500 even steps on [0.01, 0.99]


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero when b is zero."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rates(df: DataFrame, digits: int = 6) -> DataFrame:
    """Add the metrics that follow from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return df.withColumns({
        "accuracy": F.round(ratio(tp + tn, tp + fp + tn + fn), digits),
        "precision": F.round(ratio(tp, tp + fp), digits),
        "recall": F.round(ratio(tp, tp + fn), digits),
        "f1": F.round(ratio(2.0 * tp, 2 * tp + fp + fn), digits),
        "fpr": F.round(ratio(fp, fp + tn), digits),
        "fnr": F.round(ratio(fn, fn + tp), digits),
    })


def confusion(df: DataFrame, threshold: float, label: str = "label", score: str = "p_micro", by: Sequence[str] = ()) -> DataFrame:
    fake, called = F.col(label) == 1, F.col(score) >= round(threshold * cv.MICRO)
    cells = df.groupBy(*by).agg(
        F.count_if(fake & called).alias("tp"), F.count_if(~fake & called).alias("fp"),
        F.count_if(~fake & ~called).alias("tn"), F.count_if(fake & ~called).alias("fn"))
    return rates(cells)


def threshold_sweep(df: DataFrame, grid: Grid = PUBLISHED, label: str = "label", score: str = "p_micro") -> DataFrame:
    """Confusion metrics at every threshold of the grid, from one pass over the scores."""
    counted = df.groupBy(grid.cell(F.col(score)).alias("k")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    # The grid has a fixed number of rows, so these windows hold at most size + 1 rows.
    steps = df.sparkSession.range(-1, grid.size).select(F.col("id").cast("int").alias("k"))
    onward = Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    earlier = Window.partitionBy(F.lit(1)).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    full = steps.join(counted, "k", "left").select(
        "k", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    cells = full.select(
        "k", F.sum("pos").over(onward).alias("tp"), F.sum("neg").over(onward).alias("fp"),
        F.coalesce(F.sum("neg").over(earlier), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("pos").over(earlier), F.lit(0)).alias("fn"))
    return rates(cells.where("k >= 0")).withColumn("threshold", F.round(grid.value(F.col("k")), 6))


def best_threshold(sweep: DataFrame, max_fpr: float | None = None, digits: int = 5) -> DataFrame:
    """Row with the highest F1 (rounded), lowest threshold on ties; empty if no row keeps ``max_fpr``."""
    allowed = sweep if max_fpr is None else sweep.where(F.col("fpr") <= max_fpr)
    return allowed.orderBy(F.round("f1", digits).desc(), F.col("k").asc()).limit(1)


def choose_threshold(sweep: DataFrame, max_fpr: float | None = None, default: float = 0.5) -> float:
    row = best_threshold(sweep, max_fpr).select("threshold", "f1").first()
    return row["threshold"] if row and row["f1"] > 0 else default


def roc_curve(df: DataFrame, grid: Grid = ROC_GRID, label: str = "label") -> DataFrame:
    return threshold_sweep(df, grid, label).select("k", "threshold", F.col("recall").alias("tpr"), "fpr")


def grid_auc(df: DataFrame, grid: Grid = ROC_GRID, label: str = "label") -> DataFrame:
    """Absolute trapezoid under the ROC points of the grid."""
    sweep = threshold_sweep(df, grid, label)
    tpr, fpr = ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("fp"), F.col("fp") + F.col("tn"))
    w = Window.partitionBy(F.lit(1)).orderBy("k")
    area = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    return sweep.select("k", fpr.alias("x"), tpr.alias("y")).select(area.alias("a")).agg(
        F.round(F.abs(F.coalesce(F.sum("a"), F.lit(0.0))), 6).alias("auc"))


def pr_curve(df: DataFrame, grid: Grid = PR_GRID, label: str = "label") -> DataFrame:
    return threshold_sweep(df, grid, label).select("k", "threshold", "precision", "recall")


def sweep_series(sweep: DataFrame) -> DataFrame:
    """F1, FPR and recall against the threshold, with the best F1 marked."""
    w = Window.partitionBy(F.lit(1))
    best = F.min_by("k", F.struct(-F.round("f1", 5), F.col("k"))).over(w)
    return sweep.select("threshold", "f1", "fpr", "recall", (F.col("k") == best).alias("is_best"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "p_micro") -> DataFrame:
    """Exact area under the ROC curve, ties counted one half; 0.5 if a class is missing.

    Equal scores are folded first (at most 1,000,001 rows for micro scores), and
    the running count of positives is taken per thousand of them, in parallel.
    """
    folded = materialize(df.groupBy(F.col(score).alias("p")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "folded")
    ranked = running_sums(folded, "p", F.floor(F.col("p") / 1000), ["pos"])
    totals = ranked.agg(
        F.sum(F.col("neg").cast("decimal(19,0)") * (2 * F.col("pos_before") + F.col("pos")).cast("decimal(19,0)")).alias("twice"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    whole = F.col("n_pos").cast("double") * F.col("n_neg")
    return totals.select(
        F.col("n_pos"), F.col("n_neg"),
        F.when(whole > 0, F.round(F.col("twice").cast("double") / (2 * whole), 6)).otherwise(F.lit(0.5)).alias("auc"))


# --- losses ------------------------------------------------------------------

def bce(logit: Column, target: Column) -> Column:
    """Binary cross-entropy on a logit, stable for large magnitudes."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal(logit: Column, label: Column, alpha: float | None = 0.25, gamma: float = 2.0,
          smoothing: float = 0.0, class_alpha: bool = False) -> Column:
    """Focal weight (1 - pt)^gamma on the cross-entropy; ``alpha`` constant or by class."""
    target = label * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    pt = F.when(label == 1, p).otherwise(1.0 - p)
    loss = F.pow(1.0 - pt, F.lit(gamma)) * bce(logit, target)
    if alpha is None:
        return loss
    weight = F.when(label == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha)) if class_alpha else F.lit(alpha)
    return weight * loss


def losses(df: DataFrame, label: str = "label", logit: str = "logit") -> DataFrame:
    y, z = F.col(label), F.col(logit)
    smooth = F.when(y == 1, F.lit(0.95)).otherwise(F.lit(0.0))
    return df.agg(*[F.round(F.avg(x), 6).alias(n) for n, x in (
        ("log_loss", bce(z, y.cast("double"))),
        ("focal_loss", focal(z, y)),
        ("focal_smoothed", focal(z, y, alpha=None, smoothing=0.1)),
        ("focal_by_class", focal(z, y, smoothing=0.1, class_alpha=True)),
        ("smoothed_bce", bce(z, smooth)))])
