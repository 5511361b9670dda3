"""Reports whose shape is not known before: read as variants, their schema reported, opened by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.scalar import answer_json


def read_loose(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """``file, report, damaged``: a variant per document, or the text of one that is not JSON.

    Documents are whole files, or lines. Blank ones are left out. A damaged document
    stops nothing: its report is null and its text is kept. A document of a whole file is parsed by one task.
    """
    texts = spark.read.text(path, wholetext=one_document).where(F.col("value").rlike(r"\S"))
    report = F.try_parse_json("value")
    return texts.select(F.col("_metadata.file_name").alias("file"), report.alias("report"), F.when(report.isNull(), F.col("value")).alias("damaged"))


def loose_schema(reports: DataFrame, report: str = "report") -> str:
    """One schema that all reports fit in, merged inside each task first; VOID where there are none."""
    return reports.agg(F.schema_of_variant_agg(report)).first()[0]


def loose_entries(reports: DataFrame, report: str = "report") -> DataFrame:
    """One row per top-level entry, with ``key`` (null in a list), ``value`` (a variant) and ``type``; other values and nulls have none."""
    spark = reports.sparkSession
    opened = reports.lateralJoin(spark.tvf.variant_explode(F.col(report).outer()))
    return opened.withColumn("type", F.schema_of_variant("value")).drop("pos")


def loose_value(report: Column | str, path: str, kind: str) -> Column:
    """The value at a path such as ``$.a.b[0]``; null where it is missing or of another kind."""
    return F.try_variant_get(F.col(report) if isinstance(report, str) else report, path, kind)


def parse_loose_answer(text: Column) -> Column:
    """The outermost object of an answer as a variant, whatever its keys; null where there is none."""
    return F.try_parse_json(answer_json(text))
