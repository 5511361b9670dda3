"""Repeatable order, samples, oversampling, mining tiers, logs and mixing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix import conventions as cv
from curatrix.operators.profile import head_per_list
from curatrix.session import materialize


def seeded_key(item_id: Column, seed: int) -> Column:
    """Text that orders items as if at random, the same on every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), item_id.cast("string")))


def seeded_number(item_id: Column, seed: int, digits: int = 12) -> Column:
    """Whole number below 16**digits, drawn by seed and item."""
    return F.conv(F.substring(seeded_key(item_id, seed), 1, digits), 16, 10).cast("bigint")


def shuffle(df: DataFrame, seed: int, key: str = "item_id") -> DataFrame:
    return df.orderBy(seeded_key(F.col(key), seed), key)


def sample_n(df: DataFrame, n: int, seed: int, key: str = "item_id") -> DataFrame:
    """``n`` items without replacement: the head of the seeded order."""
    return shuffle(df, seed, key).limit(n)


def cap_per_class(df: DataFrame, n: int, by: Sequence[str] = ("class",), order: str = "item_id") -> DataFrame:
    return head_per_list(df, by, [order], n).drop("place")


def oversample(df: DataFrame, k: int) -> DataFrame:
    """Every row ``k`` times, numbered by ``copy``."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(k))))


def mine_hard_negatives(df: DataFrame, threshold: float = cv.DEFAULT_THRESHOLD, tiers: Sequence[float] = cv.DIFFICULTY_TIERS,
                        label: str = "label") -> DataFrame:
    """Real items called Fake, with their difficulty tier; ``below`` holds those under the first tier."""
    p = F.col("p_micro")
    easy, medium, hard = (round(t * cv.MICRO) for t in tiers)
    tier = F.when(p >= hard, "hard").when(p >= medium, "medium").when(p >= easy, "easy").otherwise("below")
    return df.where((F.col(label) == 0) & (p >= round(threshold * cv.MICRO))).withColumn("tier", tier)


def mining_report(df: DataFrame, threshold: float = cv.DEFAULT_THRESHOLD, tiers: Sequence[float] = cv.DIFFICULTY_TIERS,
                  label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Mined count, false positive rate and tier sizes, one pass."""
    p, real = F.col("p_micro"), F.col(label) == 0
    cut = round(threshold * cv.MICRO)
    easy, medium, hard = (round(t * cv.MICRO) for t in tiers)
    mined = real & (p >= cut)
    return df.groupBy(*by).agg(
        F.count_if(real).alias("n_real"), F.count_if(mined).alias("fps_mined"),
        F.count_if(mined & (p < easy)).alias("n_below"),
        F.count_if(mined & (p >= easy) & (p < medium)).alias("n_easy"),
        F.count_if(mined & (p >= medium) & (p < hard)).alias("n_medium"),
        F.count_if(mined & (p >= hard)).alias("n_hard"),
    ).withColumn("fpr", F.round(F.col("fps_mined") / F.greatest("n_real", F.lit(1)), 6))


def _in_ranges(df: DataFrame, order: Sequence[str], rows: int, slot: int, name: str) -> DataFrame:
    """Written in ranges of about ``slot`` rows, numbered in order by ``_part``."""
    ranges = df.repartitionByRange(max(1, -(-rows // slot)), *order)
    return materialize(ranges.withColumn("_part", F.spark_partition_id()), name)


def weighted_sample(df: DataFrame, weight: str, n: int | None, seed: int, key: str = "item_id", slot: int = 1_000_000) -> DataFrame:
    """``n`` draws with replacement, chance proportional to a whole-number weight; ``n`` None draws as many as there are rows.

    Items are laid end to end along the total weight, in the order of a hash of their
    key. A draw is a point on that line. Items and points are then sorted together in
    ranges of about ``slot`` rows, and a point belongs to the item before it, which for
    the first points of a range lies in an earlier one. So neither an item of great
    weight nor the draws that fall on it meet in one task. Weights that are null, zero
    or negative are never drawn; the total must stay below 2**59.
    """
    spark, rows = df.sparkSession, df.count()
    tagged = df.where(F.col(weight) > 0).withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    ranged = _in_ranges(tagged, ["_bucket", key], rows, slot, "weighted-items")
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(F.col(weight).cast("decimal(38,0)")).alias("_w"))
    total = int(sums.agg(F.sum("_w")).first()[0] or 0)
    if total >= 2 ** 59:
        raise ValueError("the total weight must stay below 2**59")
    offsets = sums.select("_part", F.coalesce(F.sum("_w").over(past), F.lit(0)).cast("bigint").alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("_bucket", key).rowsBetween(Window.unboundedPreceding, -1)
    line = ranged.join(F.broadcast(offsets), "_part").select(
        (F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0))).cast("bigint").alias("_at"),
        F.lit(None).cast("bigint").alias("draw"), F.struct(*df.columns).alias("_item"))

    draws = (n if n is not None else rows) if total else 0
    # 48 bits as long as they exceed the total a thousandfold, else 60.
    number = seeded_number(F.col("id"), seed, 12 if total <= 2 ** 38 else 15)
    points = spark.range(draws).select(
        F.pmod(number, F.lit(max(total, 1))).alias("_at"), F.col("id").alias("draw"), F.lit(None).cast(line.schema["_item"].dataType).alias("_item"))
    both = line.unionByName(points).withColumn("_point", F.col("draw").isNotNull())
    both = _in_ranges(both, ["_at", "_point"], rows + draws, slot, "weighted-line")
    last = both.groupBy("_part").agg(F.max_by("_item", F.when(~F.col("_point"), F.col("_at"))).alias("_last"))
    carried = last.select("_part", F.last("_last", ignorenulls=True).over(past).alias("_carried"))
    upto = Window.partitionBy("_part").orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.last("_item", ignorenulls=True).over(upto)).where("_point").join(F.broadcast(carried), "_part")
    return met.select("draw", F.coalesce("_here", "_carried").alias("_drawn")).select("draw", "_drawn.*")


def mixup(df: DataFrame, vector: str, label: str, batch_size: int, alpha: float, seed: int, key: str = "item_id") -> DataFrame:
    """Blend every vector with a partner of its batch: lambda * x + (1 - lambda) * partner, both labels kept.

    There are as many batches as ``batch_size`` asks for. Partners are neighbours in
    a seeded order of the batch, the last one takes the first; only ids are ordered,
    and vectors meet by two joins. lambda is drawn from Beta(alpha, alpha) once per
    batch and follows from seed and batch alone; for alpha 1 it is a uniform draw.
    """
    batches = max(1, -(-df.count() // batch_size))
    batch = F.pmod(seeded_number(F.col(key), seed), F.lit(batches)).cast("int")
    order = Window.partitionBy("batch").orderBy(seeded_key(F.col(key), seed + 1), key)
    first = F.first(key).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    drawn = seeded_number(F.col("batch"), seed) / 16 ** 12 if alpha == 1 else beta_draw(F.col("batch"), alpha, seed)
    seated = df.select(key, batch.alias("batch")).select(
        key, "batch", F.coalesce(F.lead(key).over(order), first).alias("partner_id")).withColumn("lam", drawn)
    mates = df.select(F.col(key).alias("partner_id"), F.col(vector).alias("_x"), F.col(label).alias("label_b"))
    own = df.select(key, F.col(vector).alias("_v"), F.col(label).alias("label_a"))
    mixed = F.zip_with("_v", "_x", lambda a, b: F.col("lam") * a + (1 - F.col("lam")) * b)
    return own.join(seated, key).join(mates, "partner_id").select(
        key, "partner_id", "batch", "lam", mixed.alias("mixed"), "label_a", "label_b")


def beta_draw(key: Column, alpha: float, seed: int) -> Column:
    """A number of Beta(alpha, alpha) that follows from seed and key alone, as a column expression.

    Above 1/2 it is a closed form of two uniform numbers (a symmetric beta is a
    projected point of a sphere). Otherwise powers of two uniform numbers are taken
    from a fixed sequence until their sum is at most one; a try fails with a chance
    below 0.22, later tries are only evaluated where all earlier ones failed, and
    after 30 of them (chance below 1e-19) the last one counts. A null key gives null.
    """
    if not alpha > 0:
        raise ValueError("alpha must be positive")

    def uniform(turn: Column, side: int) -> Column:
        return (seeded_number(F.concat(key.cast("string"), F.lit(":"), turn.cast("string"), F.lit(f":{side}")), seed) + 0.5) / 16 ** 12

    def attempt(found: Column, turn: Column) -> Column:
        u, v = uniform(turn, 0), uniform(turn, 1)
        fits = F.pow(u, F.lit(1 / alpha)) + F.pow(v, F.lit(1 / alpha)) <= 1
        return F.coalesce(found, F.when(fits | (turn == 29), 1 / (1 + F.exp((F.ln(v) - F.ln(u)) / alpha))))

    if alpha > 0.5:
        radius = F.sqrt(1 - F.pow(uniform(F.lit(0), 0), F.lit(2 / (2 * alpha - 1))))
        drawn = (1 + radius * F.cos(2 * math.pi * uniform(F.lit(0), 1))) / 2
    else:
        drawn = F.aggregate(F.sequence(F.lit(0), F.lit(29)), F.lit(None).cast("double"), attempt)
    return F.when(key.isNotNull(), drawn)


# --- logs --------------------------------------------------------------------

def log_deltas(log: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """First and last value and their difference, per logged column."""
    wide = log.agg(*[x for c in columns for x in (
        F.min_by(c, order).alias(f"first_{c}"), F.max_by(c, order).alias(f"last_{c}"))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.round(F.col(f"first_{c}").cast("double"), 6).alias("first"),
                 F.round(F.col(f"last_{c}").cast("double"), 6).alias("last"),
                 F.round(F.col(f"last_{c}").cast("double") - F.col(f"first_{c}").cast("double"), 6).alias("delta"))
        for c in columns])).alias("r")).select("r.*")


def best_epoch(log: DataFrame, order: str, score: str, patience: int) -> DataFrame:
    """Per epoch: running best, epochs without improvement, and where training would stop.

    A log has one row per epoch, so its order runs in a single small window.
    """
    by = Window.partitionBy(F.lit(1)).orderBy(order)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    better = F.col(score) > F.coalesce(F.max(score).over(past), F.lit(0))
    marked = log.withColumns({"improved": better, "_place": F.row_number().over(by)})
    marked = marked.withColumn("_last", F.coalesce(F.max(F.when(F.col("improved"), F.col("_place"))).over(upto), F.lit(0)))
    marked = marked.withColumns({
        "best_so_far": F.max(score).over(upto),
        "epochs_no_improve": (F.col("_place") - F.col("_last")).cast("int"),
    })
    stopped = F.max((F.col("epochs_no_improve") >= patience).cast("int")).over(past)
    return marked.select(order, score, "improved", "best_so_far", "epochs_no_improve",
                         ((F.col("epochs_no_improve") >= patience) & (F.coalesce(stopped, F.lit(0)) == 0)).alias("stops_here"))
