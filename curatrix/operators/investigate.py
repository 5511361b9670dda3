"""Why items fail: cohorts, confidence bins, failure patterns, attention maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions.scalar import rounded


def with_outcome(df: DataFrame, threshold: float, label: str = "label") -> DataFrame:
    """Add ``outcome``: TP, FP, TN or FN."""
    called, fake = F.col("p_micro") >= round(threshold * cv.MICRO), F.col(label) == 1
    return df.withColumn("outcome", F.when(fake & called, "TP").when(fake, "FN").when(called, "FP").otherwise("TN"))


def compare_cohorts(df: DataFrame, metrics: Sequence[str], one: str = "FP", other: str = "TN", flag_percent: float = 15.0) -> DataFrame:
    """Mean and population deviation of each metric in two outcome cohorts, difference and flag."""
    def of(cohort: str, metric: str) -> Column:
        return F.when(F.col("outcome") == cohort, F.col(metric).cast("double"))

    # One pass over the rows; the single result row is then turned on its side.
    wide = df.where(F.col("outcome").isin(one, other)).agg(*[
        f(of(cohort, metric)).alias(f"{metric}_{name}")
        for metric in metrics
        for cohort, side in ((one, "a"), (other, "b"))
        for f, name in ((F.avg, f"{side}_mean"), (F.stddev_pop, f"{side}_std"))])
    stats = wide.select(F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), *[F.col(f"{metric}_{n}").alias(n) for n in ("a_mean", "a_std", "b_mean", "b_std")])
        for metric in metrics])).alias("s")).select("s.*")
    delta = F.col("a_mean") - F.col("b_mean")
    percent = F.abs(delta) / F.greatest(F.abs("b_mean"), F.lit(1e-6)) * 100
    return stats.where(delta.isNotNull()).select(
        "metric", rounded(F.col("a_mean"), 3).alias("fp_mean"), rounded(F.col("a_std"), 3).alias("fp_std"),
        rounded(F.col("b_mean"), 3).alias("tn_mean"), rounded(F.col("b_std"), 3).alias("tn_std"),
        rounded(delta, 3).alias("delta"), rounded(percent, 1).alias("pct_diff"), (percent > flag_percent).alias("flagged"))


# Bin edges in hundredths; half-open, the last one closed.
CONFIDENCE_EDGES = (50, 55, 60, 65, 70, 75, 80, 85, 90, 100)


def confidence_bins(df: DataFrame) -> DataFrame:
    """Scores counted in fixed bins, empty bins kept."""
    p, last = F.col("p_micro"), len(CONFIDENCE_EDGES) - 2
    index, bounds = None, list(zip(CONFIDENCE_EDGES, CONFIDENCE_EDGES[1:]))
    for i, (lo, hi) in enumerate(bounds):
        inside = (p >= lo * 10_000) & ((p <= hi * 10_000) if i == last else (p < hi * 10_000))
        index = F.when(inside, i) if index is None else index.when(inside, i)
    counted = df.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # The list of bins is fixed and has nine rows.
    names = F.explode(F.array(*[
        F.struct(F.lit(i).alias("bin"), F.lit(f"{lo / 100:.2f}-{hi / 100:.2f}").alias("confidence"))
        for i, (lo, hi) in enumerate(bounds)])).alias("b")
    frame = df.sparkSession.range(1).select(names).select("b.*")
    return frame.join(counted, "bin", "left").select("bin", "confidence", F.coalesce("n", F.lit(0)).alias("n"))


# Pattern, metric, comparison and limit. A missing metric never fires.
FAILURE_RULES = (
    ("blur", "laplacian_var", "<", 50),
    ("smooth_skin", "skin_smoothness_std", "<", 15),
    ("low_contrast", "contrast", "<", 35),
    ("high_compression", "avg_dct_energy", "<", 500),
    ("low_edge", "edge_density_pct", "<", 3),
    ("low_noise", "noise_level", "<", 3),
    ("high_saturation", "saturation", ">", 120),
    ("dark_image", "brightness", "<", 60),
    ("small_file", "file_size_kb", "<", 20),
)


def failure_patterns(df: DataFrame, rules=FAILURE_RULES) -> DataFrame:
    """How many items each rule holds for; an item may count for several."""
    def hit(metric: str, sign: str, limit: float) -> Column:
        value = F.col(metric)
        return value < limit if sign == "<" else value > limit

    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(hit(m, s, x)).alias(name) for name, m, s, x in rules])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.col(name).alias("n_items"),
                 F.when(F.col("_n") > 0, rounded(100.0 * F.col(name) / F.col("_n"), 1)).otherwise(0.0).alias("percent"))
        for name, *_ in rules])).alias("r")).select("r.*")


def attention_regions(df: DataFrame, cam: str = "cam") -> DataFrame:
    """Centre and corner share, maximum and mean of a two-dimensional map (array of rows)."""
    rows, cols = F.size(cam), F.size(F.col(cam)[0])

    def third(n: Column) -> Column:
        return F.greatest(F.floor(n / 3).cast("int"), F.lit(1))

    def quarter(n: Column) -> Column:
        return F.greatest(F.floor(n / 4).cast("int"), F.lit(1))

    def half(n: Column) -> Column:
        return F.floor(n / 2).cast("int")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    def block(top: Column, height: Column, left: Column, width: Column) -> Column:
        """Sum over a block; ``top`` and ``left`` count from one."""
        return F.aggregate(F.slice(cam, top, height), F.lit(0.0), lambda acc, row: acc + total(F.slice(row, left, width)))

    rh, rw, qh, qw = third(rows), third(cols), quarter(rows), quarter(cols)
    centre = block(half(rows) - rh + 1, 2 * rh, half(cols) - rw + 1, 2 * rw)
    one = F.lit(1)
    corners = (block(one, qh, one, qw) + block(one, qh, cols - qw + 1, qw)
               + block(rows - qh + 1, qh, one, qw) + block(rows - qh + 1, qh, cols - qw + 1, qw))
    energy = total(F.flatten(cam)) + F.lit(1e-8)
    return df.withColumns({
        "center_pct": rounded(centre / energy * 100, 1),
        "corner_pct": rounded(corners / energy * 100, 1),
        "max_activation": rounded(F.array_max(F.flatten(cam)), 4),
        "mean_activation": rounded(total(F.flatten(cam)) / (rows * cols), 4),
    })


def attention_compare(regions: DataFrame, corner_margin: float = 5.0, center_margin: float = 10.0) -> DataFrame:
    """Cohort means (``outcome`` FP and TN) and whether the model takes a shortcut."""
    def mean(cohort: str, column: str) -> Column:
        return F.avg(F.when(F.col("outcome") == cohort, F.col(column)))

    row = regions.agg(
        mean("FP", "center_pct").alias("fc"), mean("TN", "center_pct").alias("tc"),
        mean("FP", "corner_pct").alias("fk"), mean("TN", "corner_pct").alias("tk"))
    verdict = (
        F.when(F.col("fk") > F.col("tk") + corner_margin, "corner shortcut")
        .when(F.col("fc") < F.col("tc") - center_margin, "weak center").otherwise("similar"))
    return row.select(*[rounded(F.col(c), 1).alias(n) for c, n in (
        ("fc", "fp_center_mean"), ("tc", "tn_center_mean"), ("fk", "fp_corner_mean"), ("tk", "tn_corner_mean"))],
        verdict.alias("finding"))
