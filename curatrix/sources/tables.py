"""Audit views over plain tables: items, metrics, fingerprints, scores, images.

Each view is a lazy DataFrame. Only the columns a query asks for are read from
the table; text is dropped as soon as the features are taken from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions import scalar as sc
from curatrix.functions.bits import sql_long


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Id, text and source. A session whose tables are single files that cannot be split can name a number of
    partitions in ``curatrix.input.partitions``; without it the partitions of the scan stay as they are."""
    read = table(spark, folder, "documents").select("doc_id", "text", "source")
    wanted = spark.conf.get("curatrix.input.partitions", None)
    return read.repartition(int(wanted), "doc_id") if wanted else read


def split_of(item_id: Column) -> Column:
    digit = item_id % 10
    return F.when(digit < 7, "Train").when(digit < 9, "Validation").otherwise("Test")


def class_of(source: Column) -> Column:
    return F.when(F.substring(source, 4, 10).cast("int") % 2 == 0, "Fake").otherwise("Real")


def with_identity(documents: DataFrame) -> DataFrame:
    """Documents with item_id, split and class in front."""
    return documents.withColumns({
        "item_id": F.col("doc_id"),
        "split": split_of(F.col("doc_id")),
        "class": class_of(F.col("source")),
    })


def items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per item: identity, path, stem, content hash and size."""
    return with_identity(table(spark, folder, "documents")).select(
        "item_id",
        "split",
        "class",
        F.concat_ws("/", F.lit("/store/Real/v1"), "split", "class",
                    F.concat(F.lit("item_"), F.expr("doc_id div 10"), F.lit(".txt"))).alias("path"),
        F.expr("doc_id div 10").alias("stem"),
        sc.content_hash(F.col("text")).alias("content_md5"),
        F.col("n_chars").alias("file_size"),
    )


def tokens_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def item_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Quality metrics per item with a fixed schema; unreadable items have null metrics.

    The tables hold no pixels, so text measures stand in: longest line and number
    of lines for the sides, share of letters for brightness, vocabulary for
    detail, spread of token lengths for contrast. An item is unreadable if it has no
    content or no token at all.
    """
    base = with_identity(documents(spark, folder)).select(
        "item_id", "split", "class", "text", sc.content_hash(F.col("text")).alias("file_hash"),
        F.octet_length("text").cast("bigint").alias("file_size"),
        (~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))).alias("is_corrupt"),
    )
    readable = base.withColumn("text", F.when(~F.col("is_corrupt"), F.col("text"))).withColumn(
        "lengths", F.transform(tokens_of(F.col("text")), lambda t: F.length(t)))
    total = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    squares = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda acc, n: acc + n * n)
    count = F.size("lengths")
    lines = F.split("text", "\n")
    measured = readable.withColumns({
        "width": F.array_max(F.transform(lines, lambda s: F.length(s))),
        "height": F.when(F.col("text").isNotNull(), F.size(lines)),
        "brightness": sc.rounded(
            255.0 * F.length(F.regexp_replace("text", r"[^A-Za-z]", "")) / F.length("text"), 6),
        "blur_score": F.size(F.array_distinct(tokens_of(F.col("text")))).cast("double"),
        "pixel_std": sc.rounded(F.sqrt(squares / count - (total / count) * (total / count)), 6),
    })
    measured = measured.withColumn("blur_score", F.when(~F.col("is_corrupt"), F.col("blur_score")))
    measured = measured.withColumn("aspect_ratio", sc.aspect_ratio(F.col("width"), F.col("height")))
    return measured.select(
        "item_id", "split", "class", "width", "height", "aspect_ratio", "file_size", "brightness",
        "blur_score", "file_hash", "pixel_std",
        F.coalesce(sc.is_low_res(F.col("width"), F.col("height")), F.lit(False)).alias("is_low_res"),
        F.coalesce(sc.is_blurry(F.col("blur_score")), F.lit(False)).alias("is_blurry"),
        F.coalesce(sc.is_blank(F.col("pixel_std")), F.lit(False)).alias("is_blank"),
        F.coalesce(sc.is_dark(F.col("brightness")), F.lit(False)).alias("is_dark"),
        F.coalesce(sc.is_bright(F.col("brightness")), F.lit(False)).alias("is_bright"),
        F.coalesce(sc.is_non_square(F.col("aspect_ratio")), F.lit(False)).alias("is_non_square"),
        "is_corrupt",
        F.when(F.col("is_corrupt"), F.lit("unreadable")).alias("error"),
    )


PAIR_OF_BITS = 0x0000000100000001
LOW_HALF = 0xFFFFFFFF


def token_bits(token: Column) -> Column:
    return F.conv(F.substring(F.md5(token), 1, 16), 16, -10).cast("bigint")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """64-bit SimHash of the distinct tokens of each document.

    Everything happens inside the row, so a scan task turns text into one BIGINT
    and nothing is shuffled. Each running sum counts two bits at once (i and
    i + 32), 32 bits wide each.
    """
    hashed = with_identity(documents(spark, folder)).select(
        "item_id", "split", "class", sc.content_hash(F.col("text")).alias("content_md5"),
        F.transform(F.array_distinct(tokens_of(F.col("text"))), token_bits).alias("h"))

    sums = [f"aggregate(h, 0L, (acc, x) -> acc + (shiftrightunsigned(x, {i}) & {PAIR_OF_BITS}L)) AS c{i}" for i in range(32)]
    votes = hashed.selectExpr("item_id", "split", "class", "content_md5", "cast(size(h) AS bigint) AS n", *sums)
    won = [f"if(2 * (c{i} & {LOW_HALF}L) > n, {sql_long(1 << i)}, 0L)" for i in range(32)]
    won += [f"if(2 * shiftrightunsigned(c{i}, 32) > n, {sql_long(1 << (i + 32))}, 0L)" for i in range(32)]
    return votes.selectExpr("item_id", "split", "class", "content_md5", " | ".join(won) + " AS fp")


def vec_dhash_input(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", "label")


def micro(p: Column) -> Column:
    return F.round(p * cv.MICRO).cast("bigint")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled items with the scores of two models, their mean and its logit. An item without any token has no score."""
    text = F.col("text")
    count = F.size(tokens_of(text))
    distinct = F.size(F.array_distinct(tokens_of(text)))
    scored = (
        with_identity(documents(spark, folder))
        .select(
            "item_id", "split", "class", "doc_id",
            sc.rounded(1.0 - F.try_divide(distinct, count), 6).alias("p_base"),
            sc.rounded(F.least(F.lit(1.0), F.try_divide(4.0 * (F.length(text) - plain_chars(text)), F.length(text))), 6).alias("p_hn"),
        )
    )
    labels = table(spark, folder, "labels").select(
        "doc_id", F.col("toxic").alias("label"), (1 - F.col("quality")).alias("label_q"))
    both = scored.join(labels, "doc_id").withColumn("p_ens", (F.col("p_base") + F.col("p_hn")) / 2)
    return both.select(
        "item_id", "split", "class", "label", "label_q", F.greatest("label", "label_q").alias("label_any"), "p_base", "p_hn", "p_ens",
        micro(F.col("p_ens")).alias("p_micro"),
        sc.logit(F.col("p_ens")).alias("logit"),
    )


def plain_chars(text: Column) -> Column:
    """Number of characters that are letters or white space."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\s]", ""))


def events_scored(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("item_id"), "ts", "user_id", "event_type", "value",
        F.least(F.col("value") / 100, F.lit(1.0)).alias("p"),
    )


IMAGE_WIDTH = 48
ROW_BYTES = IMAGE_WIDTH * 3


def text_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a colour image: its bytes row by row, three to a pixel.

    Rows are 48 pixels wide; the last one is filled up with spaces, so the whole
    text is in the image. Same columns as Spark's image source.
    """
    raw = F.to_binary("text", F.lit("utf-8"))
    height = F.ceil(F.octet_length("text") / ROW_BYTES).cast("int")
    return with_identity(documents(spark, folder)).select(
        "item_id", "split", "class",
        height.alias("height"),
        F.lit(IMAGE_WIDTH).alias("width"),
        F.lit(3).alias("nChannels"),
        F.rpad(raw, F.ceil(F.octet_length("text") / ROW_BYTES).cast("int") * ROW_BYTES, F.lit(b" ")).alias("data"),
        F.octet_length("text").cast("bigint").alias("file_size"),
    )
