"""Image folders and uploads as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions import scalar as sc


def scan_items(spark: SparkSession, root: str, extensions: Sequence[str] = cv.EXTENSIONS) -> DataFrame:
    """Files below ``root`` by extension, with split and class from their path.

    ``content`` is read only if a later step selects it.
    """
    either_case = ",".join(x for e in extensions for x in (e.lower(), e.upper()))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + either_case + "}").load(root)
    )
    path = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(
        path.alias("path"), sc.path_segment(path, cv.SPLITS).alias("split"), sc.path_segment(path, cv.CLASSES).alias("class"),
        sc.file_name(path).alias("stem"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


def scan_images(spark: SparkSession, root: str | list[str], extensions: Sequence[str] = cv.EXTENSIONS) -> DataFrame:
    """Decoded images below a folder, or of a list of files; a file that does not decode is a row with ``is_corrupt`` and no pixels, never a failure.

    Pixels stay in the task that read them: take features from these rows before
    joining anything, such as ``content_hashes``.
    """
    names = ",".join(x for e in extensions for x in (e.lower(), e.upper()))
    path = F.regexp_replace("image.origin", r"^file:/*", "/")
    decoded = (
        spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + names + "}").load(root)
    )
    bad = F.coalesce(F.col("image.height") <= 0, F.lit(True))
    return decoded.select(
        path.alias("path"), sc.path_segment(path, cv.SPLITS).alias("split"), sc.path_segment(path, cv.CLASSES).alias("class"),
        sc.file_name(path).alias("stem"), F.col("_metadata.file_size").alias("file_size"),
        *[F.when(~bad, F.col(f"image.{c}")).alias(c) for c in ("height", "width", "nChannels", "data")],
        bad.alias("is_corrupt"), F.when(bad, F.lit("cannot decode")).alias("error"))


def content_hashes(spark: SparkSession, root: str, extensions: Sequence[str] = cv.EXTENSIONS) -> DataFrame:
    """(path, content_md5) of every file, straight from its bytes."""
    return scan_items(spark, root, extensions).select("path", sc.content_hash(F.col("content")).alias("content_md5"))


def decode_upload(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("content", sc.decode_upload(F.col(column)))
