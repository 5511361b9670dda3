"""A quarantine that can be undone: versions of a manifest, each published by one small write after its rows are complete.

``<path>/data`` holds one folder of rows for each attempt, ``<path>/log`` one record for each version, which names its folder. Readers go by
the log alone, so rows of a failed or killed write are never seen, and two writers cannot publish the same version: the folder
of a record is made once. Files of the items themselves stay where they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version int, folder string, columns string, n_items long, note string"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All published versions: number, folder, columns, items, note. Empty where nothing was ever published."""
    if not _exists(spark, f"{path}/log"):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{path}/log/*")


def latest(spark: SparkSession, path: str) -> int:
    """Number of the last version; 0 before the first."""
    return versions(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _publish(spark: SparkSession, path: str, version: int, record: DataFrame) -> int:
    """The commit: fails where another writer has published this version already."""
    if _exists(spark, f"{path}/log/{version:08d}/_SUCCESS"):
        raise FileExistsError(f"version {version} of {path} is published already")
    record.select(F.lit(version).alias("version"), "folder", "columns", "n_items", "note").coalesce(1).write.mode("errorifexists").json(f"{path}/log/{version:08d}")
    return version


def quarantine(removed: DataFrame, path: str, note: str = "") -> int:
    """Publish ``removed`` (with split and class) as the next version, which replaces the one before; gives its number.

    No row is an empty version. A write that fails leaves the version before as it was.
    """
    spark, version = removed.sparkSession, latest(removed.sparkSession, path) + 1
    folder = f"data/{version:08d}-{uuid.uuid4().hex}"
    removed.write.partitionBy("split", "class").parquet(f"{path}/{folder}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in removed.schema.fields)
    written = spark.read.schema(columns).parquet(f"{path}/{folder}")
    record = written.agg(F.count(F.lit(1)).alias("n_items")).select(
        F.lit(folder).alias("folder"), F.lit(columns).alias("columns"), "n_items", F.lit(note).alias("note"))
    return _publish(spark, path, version, record)


def restore(spark: SparkSession, path: str, version: int) -> int:
    """Publish an earlier version again, as the next one. No row is copied, and what was published since stays readable."""
    record = versions(spark, path).where(F.col("version") == version)
    if record.isEmpty():
        raise ValueError(f"{path} has no version {version}")
    return _publish(spark, path, latest(spark, path) + 1, record.withColumn("note", F.lit(f"restored {version}")))


def read_quarantine(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of a version; of the last one if none is named."""
    wanted = latest(spark, path) if version is None else version
    record = versions(spark, path).where(F.col("version") == wanted).first()
    if record is None:
        raise ValueError(f"{path} has no version {wanted}")
    names = [f.name for f in spark.createDataFrame([], record["columns"]).schema]
    return spark.read.schema(record["columns"]).parquet(f"{path}/{record.folder}").select(*names)


def changes(spark: SparkSession, path: str, before: int, after: int, key: str = "item_id") -> DataFrame:
    """(key, change): items that entered or left between two versions."""
    old, new = (read_quarantine(spark, path, v).select(key).distinct() for v in (before, after))
    return new.join(old, key, "left_anti").withColumn("change", F.lit("entered")).unionByName(
        old.join(new, key, "left_anti").withColumn("change", F.lit("left")))


def append_record(row: DataFrame, path: str, key: str) -> None:
    """A log record under a key of its own: written again under the same key, it takes its own place."""
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/record={key}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records with their keys."""
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
