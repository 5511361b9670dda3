"""Reports, manifests, predictions and logs: readers and writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.profile import top_k

AUDIT_REPORT = (
    "exact_duplicates map<string,array<string>>, near_duplicates array<struct<path1:string,path2:string,distance:int>>, "
    "corrupt_files array<struct<path:string,error:string>>, issues array<struct<severity:string,description:string,impact:string>>")
PAIR_MANIFEST = (
    "path1 string, path2 string, distance int, split1 string, split2 string, class1 string, class2 string, label_conflict boolean")
FLIP_MANIFEST = "flips array<struct<path:string,stored:int,corrected:int>>"
SCORE_MANIFEST = "path string, prob double"


def read_report(spark: SparkSession, path: str, schema: str, one_document: bool = True) -> DataFrame:
    """JSON with a stated schema: files that are one document or list each, or with an object per line.

    A document over many lines is parsed by one task; large reports belong in lines.
    """
    return spark.read.schema(schema).option("multiLine", one_document).json(path)


def report_groups(report: DataFrame, column: str = "exact_duplicates") -> DataFrame:
    """(hash, path): one row per file of a map of groups."""
    return report.select(F.explode(column).alias("hash", "paths")).select("hash", F.explode("paths").alias("path"))


def report_list(report: DataFrame, column: str) -> DataFrame:
    """The rows of a list inside a report."""
    return report.select(F.explode(column).alias("r")).select("r.*")


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", limits: Mapping[str, tuple[list[Column | str], int]] | None = None) -> None:
    """Every table of a report in its own folder; ``limits`` cuts a list to its first rows by an order."""
    for name, df in tables.items():
        if limits and name in limits:
            order, n = limits[name]
            df = df.orderBy(*order).limit(n)
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_quarantine(removed: DataFrame, path: str) -> None:
    """Manifest of quarantined items by split and class. Files stay where they are, so it can be undone."""
    removed.write.mode("overwrite").partitionBy("split", "class").parquet(path)


def append_log(row: DataFrame, path: str) -> None:
    """Append one record; a log is read back in the order of its own column."""
    row.coalesce(1).write.mode("append").parquet(path)


def export_samples(df: DataFrame, n: int, prefix: str, p: str = "p_micro", name: str = "item_id") -> DataFrame:
    """The ``n`` highest scores with a name that carries rank and score."""
    ranked = top_k(df, [F.col(p).desc(), name], n)
    return ranked.withColumn("sample_name", F.concat(
        F.lit(prefix + "_"), F.format_string("%03d", F.col("rank") - 1), F.lit("_p"),
        F.format_string("%.3f", F.round(F.col(p) / 1_000_000, 3)), F.lit("_"), F.col(name).cast("string")))
