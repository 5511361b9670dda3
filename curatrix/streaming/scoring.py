"""Scoring as a stream: the same column functions as in batch, an append sink with a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix.functions import scalar as sc
from curatrix.operators.calibration import score
from curatrix.sources.tables import events_scored


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New event files below ``folder`` as a stream, with the schema of those already there."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def score_events(events: DataFrame, threshold: float = 0.52, temperature: float = 1.0) -> DataFrame:
    """Verdict, risk and band for every event; no state, so batch and stream agree row by row."""
    scored = events_scored(events)
    p = sc.sigmoid(sc.logit(F.col("p")), temperature)
    points = F.round(p * 100, 4)
    return scored.select(
        "item_id", "event_type", F.round(p, 6).alias("p"),
        sc.calibrated_verdict(F.round(p, 6), threshold)["verdict"].alias("verdict"),
        sc.risk_verdict(points)["verdict"].alias("risk_verdict"),
        sc.score_band(points).alias("band"))


def score_items(items: DataFrame, model, signals: dict[str, Column]) -> DataFrame:
    """Probability of a fitted model, and the heuristic score of ``signals``, for every item; batch and stream alike."""
    found = score(model, items).withColumn("_h", sc.heuristic_score(signals))
    return found.select("item_id", F.round("p", 6).alias("p"), F.col("_h.score").alias("heuristic"),
                        sc.risk_verdict(F.col("_h.score"))["verdict"].alias("risk_verdict"))


def stream_items(items: DataFrame, model, signals: dict[str, Column], sink: str, checkpoint: str) -> StreamingQuery:
    """``score_items`` over a stream, appended to a Parquet folder."""
    return (
        score_items(items, model, signals).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    )


def score_stream(events: DataFrame, sink: str, checkpoint: str, **options) -> StreamingQuery:
    """Score a stream into a Parquet folder; ``availableNow`` empties the source and stops."""
    return (
        score_events(events, **options).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    )
