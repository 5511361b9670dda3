"""Label quality: corrections, ensembles, conflicts with the scores, class overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.operators import metrics as m
from curatrix.operators.profile import histogram


def exclude(df: DataFrame, bad: DataFrame, key: str = "item_id") -> DataFrame:
    return df.join(bad.select(key), key, "left_anti")


def existing_only(edges: DataFrame, items: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Edges whose two ends are still among the items."""
    ids = items.select("item_id")
    return edges.join(ids, edges[a] == ids["item_id"], "left_semi").join(ids, edges[b] == ids["item_id"], "left_semi")


def apply_corrections(df: DataFrame, flips: DataFrame, label: str = "label") -> DataFrame:
    """Add ``corrected``: the label of the manifest (item_id, corrected) where it names the item, else the stored one.

    A manifest that names an item more than once counts once: by its last line where
    it has a column ``line``, else by its largest label.
    """
    order = "line" if "line" in flips.columns else "corrected"
    named = flips.groupBy("item_id").agg(F.max_by("corrected", order).alias("_flip"))
    return df.join(named, "item_id", "left").withColumn("corrected", F.coalesce("_flip", label)).drop("_flip")


def ensemble(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two models' scores (item_id, p), joined by item, not by position."""
    return a.select("item_id", F.col("p").alias("p_a")).join(b.select("item_id", F.col("p").alias("p_b")), "item_id").withColumn(
        "p_ens", (F.col("p_a") + F.col("p_b")) / 2)


def merge_verdicts(model: DataFrame, second: DataFrame) -> DataFrame:
    """Second opinions (item_id, verdict, risk_score, confidence, summary) corrected by the model's answer.

    Without a model answer the second opinion stands as it is.
    """
    own = model.select("item_id", *[F.col(c).alias(f"m_{c}") for c in ("is_fake", "confidence", "risk_score", "verdict")])
    both = second.join(own, "item_id", "left")
    fake, sure = F.col("m_is_fake"), F.col("m_confidence")
    wording = F.when(fake, F.when(sure >= 85, "LIKELY DEEPFAKE").otherwise("POSSIBLY DEEPFAKE")).otherwise(
        F.when(sure >= 75, "LIKELY AUTHENTIC").otherwise("INCONCLUSIVE"))
    risk = F.when(fake, F.greatest("risk_score", "m_risk_score")).otherwise(F.least("risk_score", "m_risk_score"))
    prefix = F.concat(F.lit("[model: "), F.col("m_verdict"), F.lit(" at "), F.round(sure, 1).cast("string"), F.lit("%] "))
    known = fake.isNotNull()
    return both.select(
        "item_id",
        F.when(known, wording).otherwise(F.col("verdict")).alias("verdict"),
        F.when(known, risk).otherwise(F.col("risk_score")).alias("risk_score"),
        F.when(known, F.greatest("confidence", "m_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(known, F.concat(prefix, F.col("summary"))).otherwise(F.col("summary")).alias("summary"))


def in_band(p: Column, band=cv.AMBIGUOUS_BAND) -> Column:
    return p.between(round(band[0] * cv.MICRO), round(band[1] * cv.MICRO))


def ambiguous(df: DataFrame, band=cv.AMBIGUOUS_BAND) -> DataFrame:
    return df.where(in_band(F.col("p_micro"), band))


def boundary_report(df: DataFrame, label: str = "label", band=cv.AMBIGUOUS_BAND) -> DataFrame:
    """Share of each class inside the ambiguous band."""
    return df.groupBy(F.when(F.col(label) == 1, "Fake").otherwise("Real").alias("class_name")).agg(
        F.count_if(in_band(F.col("p_micro"), band)).alias("n_ambiguous"), F.count(F.lit(1)).alias("n_total")
    ).withColumn("share", F.round(F.col("n_ambiguous") / F.col("n_total"), 6))


def mislabel_candidates(df: DataFrame, confidence: float = cv.MISLABEL_CONFIDENCE, label: str = "label") -> DataFrame:
    """Items whose score contradicts their label with at least this confidence; sort by ``disagreement``."""
    high, low = round(confidence * cv.MICRO), round((1 - confidence) * cv.MICRO)
    p, fake = F.col("p_micro"), F.col(label) == 1
    gap = F.abs(p - F.col(label).cast("bigint") * cv.MICRO)
    return df.where((fake & (p < low)) | (~fake & (p > high))).withColumn("disagreement", gap)


def class_overlap(df: DataFrame, label: str = "label", bins: int = 20) -> DataFrame:
    """Common area of the two classes' score densities on [0, 1]: 0 apart, 1 equal."""
    scored = df.select(F.col(label).alias("y"), (F.col("p_micro") / cv.MICRO).alias("p"))
    dens = histogram(scored, "p", bins, 0.0, 1.0, by=["y"])
    wide = dens.groupBy("bin").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    # Densities times bin width are shares of the class, so the widths cancel.
    sums = wide.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.collect_list(F.struct("a", "b")).alias("cells"))
    shared = F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.least(
        c["a"] / F.nullif(F.col("na"), F.lit(0)), c["b"] / F.nullif(F.col("nb"), F.lit(0))))
    return sums.select(F.round(F.coalesce(shared, F.lit(0.0)), 6).alias("overlap"))


def flip_report(df: DataFrame, threshold: float, label: str = "label", corrected: str = "corrected") -> DataFrame:
    """Metrics on stored and on corrected labels side by side."""
    return reduce(DataFrame.unionByName, [
        m.confusion(df, threshold, column).select(F.lit(name).alias("labels"), "*")
        for name, column in (("stored", label), ("corrected", corrected))])


def average_passes(passes: DataFrame) -> DataFrame:
    """Mean score per item over several scoring passes (item_id, label, p_micro)."""
    return passes.groupBy("item_id").agg(
        F.max("label").alias("label"), F.floor(F.avg("p_micro") + 0.5).cast("bigint").alias("p_micro"))
