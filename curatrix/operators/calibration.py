"""Probability calibration, threshold recommendations and baseline scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions import scalar as sc
from curatrix.operators import isotonic as iso
from curatrix.operators import labels as lb
from curatrix.operators import metrics as m
from curatrix.session import materialize


def _folded(df: DataFrame, logit: str, label: str) -> DataFrame:
    """Rows with the same score and label folded to one weighted row."""
    return df.groupBy(F.col(logit).alias("z"), F.col(label).cast("double").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def fit_temperature(df: DataFrame, logit: str = "logit", label: str = "label", tolerance: float = 1e-9, max_steps: int = 60) -> float:
    """Temperature T that minimises the cross-entropy of logit / T.

    The loss is convex in beta = 1 / T: each Newton step is one aggregation of
    slope and curvature over the folded scores. A step that would leave the
    positive side is halved instead, and T stays within [0.001, 1000], which
    ends the search on data that has no finite optimum.
    """
    folded = materialize(_folded(df, logit, label), "scores")
    beta = 1.0
    for _ in range(max_steps):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z") * beta))
        row = folded.agg(
            F.sum(F.col("w") * F.col("z") * (p - F.col("y"))).alias("slope"),
            F.sum(F.col("w") * F.col("z") * F.col("z") * p * (1.0 - p)).alias("curve")).first()
        if not row["curve"]:
            break
        step = row["slope"] / row["curve"]
        following = min(max(beta - step if beta - step > 0 else beta / 2, 1e-3), 1e3)
        done = abs(following - beta) < tolerance
        beta = following
        if done:
            break
    else:
        raise RuntimeError(f"the temperature did not settle in {max_steps} steps")
    return 1.0 / beta


def _one_feature(df: DataFrame, logit: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.array(F.col(logit).cast("double"))))


def fit_platt(df: DataFrame, logit: str = "logit", label: str = "label") -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the logit."""
    folded = _one_feature(_folded(df, logit, label), "z")
    model = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", regParam=0.0, tol=1e-12,
                               maxIter=200, standardization=False).fit(folded)
    return float(model.coefficients[0]), float(model.intercept)


def fit_isotonic(df: DataFrame, score: str = "p_micro", label: str = "label") -> DataFrame:
    """Blocks of the monotone map from score to probability."""
    return iso.fit(df, score, label)


def apply_isotonic(blocks: DataFrame, df: DataFrame, score: str = "p_micro") -> DataFrame:
    return iso.apply(blocks, df, score)


def _micro(p: Column) -> Column:
    return F.round(p * cv.MICRO).cast("bigint")


def calibrated_scores(fit_on: DataFrame, apply_to: DataFrame, label: str = "label") -> dict[str, DataFrame]:
    """``apply_to`` with its p_micro replaced by each calibration fitted on ``fit_on``."""
    temperature = fit_temperature(fit_on, label=label)
    slope, intercept = fit_platt(fit_on, label=label)
    isotonic = fit_isotonic(fit_on, label=label)
    return {
        "uncalibrated": apply_to,
        "temperature": apply_to.withColumn("p_micro", _micro(sc.sigmoid(F.col("logit"), temperature))),
        "platt": apply_to.withColumn("p_micro", _micro(sc.sigmoid(F.col("logit") * slope + intercept))),
        "isotonic": apply_isotonic(isotonic, apply_to).withColumn("p_micro", _micro(F.col("p_iso"))).drop("p_iso"),
    }


def calibration_recommendations(df: DataFrame, current: float = cv.DEFAULT_THRESHOLD, max_fpr: float | None = None,
                                label: str = "label") -> DataFrame:
    """Best threshold per calibration method, and the metrics at the one in use."""
    columns = ["threshold", "accuracy", "precision", "recall", "f1", "fpr", "fnr", "tp", "fp", "tn", "fn"]
    rows = [
        m.best_threshold(m.threshold_sweep(scored, m.CALIBRATION, label), max_fpr).select(F.lit(name).alias("method"), *columns)
        for name, scored in calibrated_scores(df, df, label).items()]
    now = m.confusion(df, current, label).withColumn("threshold", F.lit(current)).select(F.lit("in use").alias("method"), *columns)
    return reduce(DataFrame.unionByName, [now, *rows])


def honest_eval(validation: DataFrame, test: DataFrame, flips: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Temperature and threshold from Validation only; metrics on Test with corrected and with stored labels."""
    temperature = fit_temperature(validation, label=label)

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumn("p_micro", _micro(sc.sigmoid(F.col("logit"), temperature)))

    threshold = m.choose_threshold(m.threshold_sweep(scaled(validation), m.PUBLISHED, label))
    scored = scaled(test)
    scored = scored.withColumn("corrected", F.col(label)) if flips is None else lb.apply_corrections(scored, flips, label)
    report = lb.flip_report(scored, threshold, label, "corrected")
    areas = reduce(DataFrame.unionByName, [
        m.roc_auc(scored, column).select(F.lit(name).alias("labels"), "auc")
        for name, column in (("stored", label), ("corrected", "corrected"))])
    return report.join(areas, "labels").withColumns({
        "temperature": F.round(F.lit(temperature), 6), "threshold": F.lit(threshold)})


# --- baseline scoring --------------------------------------------------------

def fit_baseline(train: DataFrame, features: Sequence[str], label: str = "label") -> PipelineModel:
    """Standardised logistic regression over feature columns, in place of an image network.

    Rows that lack a feature cannot be learnt from; ``score`` gives them a null score.
    """
    train = train.dropna(subset=[*features, label])
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="_features", labelCol=label, rawPredictionCol="_margin",
                           probabilityCol="_probability", predictionCol="_prediction", maxIter=100, tol=1e-9),
    ]).fit(train)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add logit, p and p_micro to every row; they are null where a feature is missing."""
    scored = model.transform(df)
    margin = F.nanvl(vector_to_array("_margin")[1], F.lit(None).cast("double"))
    p = F.nanvl(vector_to_array("_probability")[1], F.lit(None).cast("double"))
    return scored.withColumns({"logit": margin, "p": p, "p_micro": _micro(p)}).drop(
        "_raw", "_features", "_margin", "_probability", "_prediction")


def score_external(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], columns: Sequence[str], key: str = "item_id") -> DataFrame:
    """Batch scores of a model the user brings: ``load`` runs once per task, its result scores Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "p": predict(batch[list(columns)]).astype("float64")})

    id_type = df.schema[key].dataType.simpleString()
    return df.select(key, *columns).mapInPandas(run, f"{key} {id_type}, p double")
