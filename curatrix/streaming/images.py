"""An image folder as a stream: new files are decoded and measured in tasks, and each micro-batch is written once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curatrix import conventions as cv
from curatrix.operators import pixels as px
from curatrix.sources.images import scan_images

FILES = "path string, modificationTime timestamp, length bigint, content binary"
CARRIED = ("path", "split", "class", "stem", "height", "width", "file_size", "is_corrupt", "error")


def read_image_files(spark: SparkSession, root: str, files_per_trigger: int = 1_000, extensions: Sequence[str] = cv.EXTENSIONS) -> DataFrame:
    """(path) of new image files below ``root`` as a stream; the bytes are not read here."""
    names = ",".join(x for e in extensions for x in (e.lower(), e.upper()))
    return (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + names + "}").option("maxFilesPerTrigger", files_per_trigger).load(root).select("path")
    )


def image_features(images: DataFrame, families: Sequence[str] = ("basic", "blur")) -> DataFrame:
    """Features of decoded images, with what their paths say; the same for a batch and for a stream."""
    return px.pixel_features(images, families, carry=CARRIED)


def stream_features(spark: SparkSession, root: str, sink: str, checkpoint: str, files_per_trigger: int = 1_000,
                    work: Callable[[DataFrame], DataFrame] = image_features) -> StreamingQuery:
    """``work`` over all new files, in micro-batches of at most ``files_per_trigger``; ends when the folder is empty of new ones.

    The driver holds the paths of one micro-batch. A micro-batch owns the folder ``batch=<its number>`` of the sink: when it is replayed after a
    failure, with the same number and the same files, it takes the place of what it had written. A file that does not decode is a row with
    an error. A changed file is a new one only under a new name.
    """
    def write(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.select("path").collect()]
        if paths:
            work(scan_images(files.sparkSession, paths)).write.mode("overwrite").parquet(f"{sink}/batch={number:08d}")

    return (
        read_image_files(spark, root, files_per_trigger).writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_features(spark: SparkSession, sink: str) -> DataFrame:
    """What all micro-batches have written, without their numbers."""
    return spark.read.parquet(sink).drop("batch").where(F.col("path").isNotNull())
