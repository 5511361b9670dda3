"""Helpers that several operators share: batches of text in tasks, names of words, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.session import scratch_path

ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words are runs of anything but these six; ``bytes.split()`` cuts at exactly the same bytes.
SPACES = " \t\n\x0b\x0c\r"

MASK = (1 << 64) - 1
#: Two odd bases of the polynomial word names, and the multiplier that joins them.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
JOIN = np.uint64(0xD6E8FEB86659FD93)


def raw(name: str = "text") -> Column:
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary")


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of all batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


class Out:
    """Gathers rows and gives them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 20_000):
        self.schema, self.limit, self.rows = schema, limit, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def full(self) -> bool:
        return len(self.rows) >= self.limit

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows = []
        return batch


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordNames:
    """64-bit names of byte ranges: the sum of a hash of each byte together with its place in the range, mixed with the length.

    Equal bytes get equal names anywhere, without a dictionary, so names need no
    shuffle. Powers of two bases, for sums over words, are kept and grow with the longest text seen.
    """

    def __init__(self) -> None:
        self.power = [np.ones(1, np.uint64) for _ in BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in BASES]

    def _grow(self, n: int) -> None:
        while len(self.power[0]) < n:
            m = len(self.power[0])
            for table, bases in ((self.power, BASES), (self.inverse, [pow(b, -1, 1 << 64) for b in BASES])):
                for k, base in enumerate(bases):
                    table[k] = np.concatenate([table[k], table[k] * np.uint64(pow(base, m, 1 << 64))])

    def __call__(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        edges = np.cumsum(sizes)
        place = np.arange(edges[-1] if len(edges) else 0) - np.repeat(edges - sizes, sizes)
        value = mix((place.astype(np.uint64) << np.uint64(8) | text[place + np.repeat(starts, sizes)]) * JOIN + JOIN)
        sums = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        return mix((sums[edges] - sums[edges - sizes]) * JOIN + sizes.astype(np.uint64))


def spans(words: list[bytes], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words that are joined by ``gap`` bytes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + gap) - gap
    return ends - sizes, ends


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run meanwhile removes its shuffle files when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILTER_BITS = 1 << 23


def _flagged(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with ``_hit``: may their key be among ``ids``? An inner join drops most that are not at once."""
    def position(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    bits = ids.where(F.col(key).isNotNull()).select(position(F.col(key)).alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position(position(F.col(key)))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(position(F.col(key))), "_at": at}).join(F.broadcast(bits), "_bucket", how)
    return met.withColumn("_hit", F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False)))


def maybe_in(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among ``ids``: all that are, and few others, found without moving any row.

    Keys set bits of a bitmap of FILTER_BITS bits (one megabyte, whatever the input), which is broadcast. With very many ids it
    lets everything through, so it only ever saves; a join has to follow.
    """
    return _flagged(rows, ids, key, "inner").where("_hit").select(*rows.columns)


def parted(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among ``ids``, and all others; see ``maybe_in``."""
    flagged = _flagged(rows, ids, key, "left")
    return flagged.where("NOT _hit").select(*rows.columns), flagged.where("_hit").select(*rows.columns)


#: Bits of a filter of hashes: 16 megabytes, whatever the input. More hashes only let more through.
MAP_BITS = 1 << 27
BUCKET_BITS = 1 << 15
NEVER = (1 << 63) - 1


def filters(hashes: DataFrame, crowded: int = NEVER) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters, with two bits for each, of the hashes and of those with more than ``crowded`` regions; their size is fixed."""
    with shuffles_dropped(hashes.sparkSession):
        places = F.array(F.col("key").bitwiseAND(F.lit(MAP_BITS - 1)), F.shiftrightunsigned("key", 27).bitwiseAND(F.lit(MAP_BITS - 1)))
        rows = hashes.select("n", F.explode(places).alias("place")).select(
            "n", (F.col("place") / BUCKET_BITS).cast("int").alias("bucket"), (F.col("place") % BUCKET_BITS).alias("bit")).groupBy("bucket").agg(
            F.expr("bitmap_construct_agg(bit)").alias("every"),
            F.expr(f"if(max(n) > {crowded}, bitmap_construct_agg(bit) FILTER (WHERE n > {crowded}), NULL)").alias("many")).collect()
    out = []
    for name in ("every", "many"):
        bits = np.zeros((MAP_BITS // BUCKET_BITS, BUCKET_BITS // 8), np.uint8)
        for row in rows:
            if row[name]:
                bits[row.bucket] = np.frombuffer(bytes(row[name]), np.uint8)
        out.append(bits.reshape(-1))
    return out[0], out[1]


def among(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for place in (keys & np.uint64(MAP_BITS - 1), keys >> np.uint64(27) & np.uint64(MAP_BITS - 1)):
        found &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found
