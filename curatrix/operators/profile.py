"""Dataset audit: counts, profiles, flags, exact copies, leakage and ranked issues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from curatrix import conventions as cv
from curatrix.operators.skew import lookup_join
from curatrix.session import materialize

PROFILE_COLUMNS = ("width", "height", "aspect_ratio", "brightness", "blur_score", "pixel_std", "file_size")
FLAG_COLUMNS = ("is_low_res", "is_non_square", "is_dark", "is_bright", "is_blurry", "is_blank", "is_corrupt")


def one_of(names: Sequence[str], column: str) -> Column:
    """Bit mask with one bit per known name."""
    mask = F.when(F.col(column) == names[0], 1)
    for i, name in enumerate(names[1:], 1):
        mask = mask.when(F.col(column) == name, 1 << i)
    return mask.otherwise(0)


def names_of(mask: Column, names: Sequence[str]) -> Column:
    """The names behind a mask, sorted and joined with '+'."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return F.array_join(F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, names[i]) for i in order])), "+")


# --- counts and profiles -----------------------------------------------------

def counts(items: DataFrame) -> DataFrame:
    """Items per split and class, per split, per class and in all, with their share; one pass."""
    cubed = items.cube("split", "class").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    total = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cubed.select(
        F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("class", F.lit("all")).alias("class"), "n",
        F.round(F.col("n") / F.max("n").over(total), 6).alias("share"))


# Rank share around the middle that the median bracket covers, and the sketch's accuracy.
MEDIAN_MARGIN = 0.002
SKETCH_ACCURACY = 10_000


def _bracket(column: str) -> Column:
    """Values just below and just above the middle, by quantile sketch."""
    return F.percentile_approx(F.col(column).cast("double"), [0.5 - MEDIAN_MARGIN, 0.5 + MEDIAN_MARGIN], SKETCH_ACCURACY)


MEDIAN_BUCKETS = 1000


def _medians_inside(df: DataFrame, brackets: dict[str, tuple[float, float, int]]) -> DataFrame:
    """(metric, median), exact, given (low, high, count of values) per column.

    The sketch's rank error (1 / SKETCH_ACCURACY) is below MEDIAN_MARGIN, so the
    bracket holds the median. Only values inside it are counted one by one, a
    fixed small share of the data; all below fold into one row, all above vanish.
    Ranks are found in two levels: sums of MEDIAN_BUCKETS equal parts of each
    bracket, then the values of the one or two parts that hold the middle.
    """
    def per_metric(position: int) -> Column:
        out = F.lit(None)
        for c, known in brackets.items():
            out = F.when(F.col("metric") == c, F.lit(known[position])).otherwise(out)
        return out

    pairs = ", ".join(f"'{c}', CAST(`{c}` AS double)" for c in brackets)
    low, high, total = per_metric(0).cast("double"), per_metric(1).cast("double"), per_metric(2).cast("bigint")
    value = F.col("value")
    part = F.when(value.isNull(), -1).when(high > low, F.least(
        F.floor((value - low) / (high - low) * MEDIAN_BUCKETS), F.lit(MEDIAN_BUCKETS - 1)).cast("int")).otherwise(0)
    counted = materialize(
        df.selectExpr(f"stack({len(brackets)}, {pairs}) AS (metric, value)").where(value <= high)
        .groupBy("metric", F.when(value >= low, value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("part", part), "bracket")
    # At most MEDIAN_BUCKETS + 1 rows per metric.
    before = Window.partitionBy("metric").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy("metric", "part").agg(F.sum("n").alias("_n")).select(
        "metric", "part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), total.alias("_total"))
    middle = parts.where("_before <= _total div 2 AND _before + _n > (_total - 1) div 2").drop("_n")
    upto = Window.partitionBy("metric", "part").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(F.broadcast(middle), ["metric", "part"]).withColumn("_upto", F.col("_before") + F.sum("n").over(upto))

    def at(rank: str) -> Column:
        return F.min(F.when((F.col("_upto") > F.expr(rank)) & value.isNotNull(), value))

    # Zero-based middle ranks.
    return ranked.groupBy("metric").agg(((at("(_total - 1) div 2") + at("_total div 2")) / 2).alias("median"))


def exact_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, median) of every column that has values, exact, in two even passes."""
    row = df.agg(*[x for c in columns for x in (_bracket(c).alias(f"q_{c}"), F.count(c).alias(f"n_{c}"))]).first()
    return _medians_inside(df, {c: (*row[f"q_{c}"], row[f"n_{c}"]) for c in columns if row[f"n_{c}"]})


def profile(df: DataFrame, columns: Sequence[str] = PROFILE_COLUMNS, exact: bool = True) -> DataFrame:
    """One row per metric: count of values, min, max, median, mean, population standard deviation.

    All columns share one pass; the exact median adds a second. ``exact=False``
    takes the median from the sketch.
    """
    wide = [("n", lambda c: F.count(c)), ("min", lambda c: F.min(c)), ("max", lambda c: F.max(c)),
            ("mean", lambda c: F.avg(c)), ("std", lambda c: F.stddev_pop(c)), ("q", _bracket)]
    row = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).agg(
        *[f(c).alias(f"{name}_{c}") for c in columns for name, f in wide]).first()

    def number(value) -> Column:
        return F.round(F.lit(value).cast("double"), 6)

    facts = df.sparkSession.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.lit(row[f"n_{c}"]).cast("bigint").alias("n"),
                 *[number(row[f"{name}_{c}"]).alias(name) for name in ("min", "max", "mean", "std")],
                 number(sum(row[f"q_{c}"]) / 2 if row[f"n_{c}"] else None).alias("sketch")) for c in columns])).alias("f")).select("f.*")
    if not exact:
        return facts.withColumnRenamed("sketch", "median").select("metric", "n", "min", "max", "median", "mean", "std")
    brackets = {c: (*row[f"q_{c}"], row[f"n_{c}"]) for c in columns if row[f"n_{c}"]}
    if not brackets:
        return facts.select("metric", "n", "min", "max", F.lit(None).cast("double").alias("median"), "mean", "std")
    return facts.join(_medians_inside(df, brackets), "metric", "left").select(
        "metric", "n", "min", "max", F.round("median", 6).alias("median"), "mean", "std")


def flag_rates(df: DataFrame, flags: Sequence[str] = FLAG_COLUMNS) -> DataFrame:
    """Count and percentage of items per flag: of all items for ``is_corrupt``, of the readable ones for the others."""
    totals = df.agg(F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("is_corrupt")).alias("_valid"), *[F.count_if(F.col(f)).alias(f) for f in flags])

    def percent(flag: str) -> Column:
        n = F.col("_all" if flag == "is_corrupt" else "_valid")
        return F.when(n > 0, F.round(100.0 * F.col(flag) / n, 6)).otherwise(0.0)

    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("flag"), F.col(f).alias("n_flagged"), percent(f).alias("percent")) for f in flags])).alias("r")).select("r.*")


def class_balance(items: DataFrame) -> DataFrame:
    grouped = items.groupBy("split").agg(
        F.count_if(F.col("class") == "Fake").alias("n_fake"), F.count_if(F.col("class") == "Real").alias("n_real"))
    total = F.col("n_fake") + F.col("n_real")
    gap = F.abs(F.col("n_fake") - F.col("n_real"))
    return grouped.withColumn("imbalance", F.when(total > 0, F.round(gap / total, 6)).otherwise(0.0))


def histogram(df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None,
              by: Sequence[str] = (), density: bool = False) -> DataFrame:
    """Equal-width counts, every bin present; the last bin is closed. Range from the data if not given."""
    value = F.col(column).cast("double")
    if lo is None or hi is None:
        found = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        lo = found["lo"] if lo is None else lo
        hi = found["hi"] if hi is None else hi
    if lo is None or hi is None:
        lo, hi = 0.0, 1.0
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((value - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    inside = df.where(value.between(lo, hi)).groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most ``bins`` counts per group come together here, to fill in the empty bins.
    known = inside.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts"), F.sum("n").alias("_total"))
    full = known.select(*by, "_counts", "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = full.select(
        *by, "bin", F.coalesce(F.try_element_at("_counts", F.col("bin")), F.lit(0)).alias("n"), "_total"
    ).withColumns({
        "lower": F.round(F.lit(lo) + F.col("bin") * width, 6),
        "upper": F.round(F.lit(lo) + (F.col("bin") + 1) * width, 6),
    })
    if density:
        out = out.withColumn("density", F.round(F.col("n") / (F.col("_total") * width), 6))
    return out.drop("_total")


# --- exact copies and leakage ------------------------------------------------

def exact_dup_groups(items: DataFrame, key: str = "content_md5") -> DataFrame:
    """Groups of equal content: size, surplus copies, first item, splits and classes they touch."""
    return (
        items.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_id"),
             F.bit_or(one_of(cv.SPLITS, "split")).alias("split_mask"),
             F.bit_or(one_of(cv.CLASSES, "class")).alias("class_mask"))
        .where("n_items > 1")
        .select(key, "n_items", (F.col("n_items") - 1).alias("surplus"), "first_id", "split_mask", "class_mask",
                names_of(F.col("split_mask"), cv.SPLITS).alias("splits"),
                names_of(F.col("class_mask"), cv.CLASSES).alias("classes"))
    )


def exact_dup_members(items: DataFrame, key: str = "content_md5", heavy: int | None = None) -> DataFrame:
    """Every item that has a copy, with its group: one row each, never a list per group; ``heavy`` as in ``lookup_join``."""
    groups = exact_dup_groups(items, key).select(key, "n_items", "first_id", "splits", "classes")
    return lookup_join(items, groups, [key], "n_items", heavy)


def cross_split_exact(groups: DataFrame) -> DataFrame:
    """Groups over more than one split, per set of splits: groups, files, label agreement."""
    conflict = F.bit_count("class_mask") > 1
    return groups.where(F.bit_count("split_mask") > 1).groupBy("splits").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_items").alias("n_files"),
        F.count_if(~conflict).alias("consistent"), F.count_if(conflict).alias("conflicting"))


def label_conflicts(groups: DataFrame) -> DataFrame:
    """Groups whose copies carry both classes, and whether they also cross splits."""
    return groups.where(F.bit_count("class_mask") > 1).select(
        "content_md5", "n_items", "splits", (F.bit_count("split_mask") > 1).alias("crosses_splits"))


def spanning_by_key(items: DataFrame, key: str) -> DataFrame:
    """Per key: items and splits, for keys that occur in more than one split."""
    return (
        items.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_items"), F.bit_or(one_of(cv.SPLITS, "split")).alias("split_mask"))
        .where(F.bit_count("split_mask") > 1)
    )


def reuse_by_split_set(items: DataFrame, key: str) -> DataFrame:
    """Keys (stems, hashes) in two or more splits, counted per set of splits."""
    return spanning_by_key(items, key).groupBy(names_of(F.col("split_mask"), cv.SPLITS).alias("splits")).agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_items").alias("n_items"))


def shared_hash_matrix(items: DataFrame, key: str = "content_md5") -> DataFrame:
    """Distinct hashes shared by each pair of splits: one aggregation over per-hash split masks."""
    masks = items.where(F.col(key).isNotNull()).groupBy(key).agg(F.bit_or(one_of(cv.SPLITS, "split")).alias("m"))
    pairs = list(combinations(range(len(cv.SPLITS)), 2))
    wide = masks.agg(*[
        F.count_if(F.col("m").bitwiseAND(F.lit(1 << i | 1 << j)) == (1 << i | 1 << j)).alias(f"s{i}{j}") for i, j in pairs])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(cv.SPLITS[i]).alias("split_a"), F.lit(cv.SPLITS[j]).alias("split_b"), F.col(f"s{i}{j}").alias("n_shared"))
        for i, j in pairs])).alias("r")).select("r.*")


def shared_hash_items(items: DataFrame, key: str = "content_md5") -> DataFrame:
    """The items behind every hash that two splits share."""
    shared = spanning_by_key(items, key).select(key, "n_items")
    return lookup_join(items, shared, [key], "n_items").select(key, "item_id", "split", "class")


# --- summary and issues ------------------------------------------------------

def audit_summary(metrics: DataFrame, near_pairs: DataFrame) -> DataFrame:
    """The headline counts in one row; ``near_pairs`` holds blocks with n_pairs."""
    ok = ~F.col("is_corrupt")
    base = metrics.agg(
        F.count(F.lit(1)).alias("total_images"), F.count_if(ok).alias("valid_images"),
        F.count_if(F.col("is_corrupt")).alias("corrupt_images"),
        *[F.count_if(ok & (F.col("class") == c)).alias(f"class_{c.lower()}") for c in cv.CLASSES],
        *[F.count_if(ok & (F.col("split") == s)).alias(f"split_{s.lower()}") for s in cv.SPLITS],
        *[F.count_if(ok & F.col(f)).alias(n) for f, n in (
            ("is_low_res", "low_resolution_count"), ("is_blurry", "blurry_count"), ("is_blank", "blank_count"),
            ("is_dark", "very_dark_count"), ("is_bright", "very_bright_count"), ("is_non_square", "non_square_count"))],
    )
    groups = exact_dup_groups(metrics.where(ok), "file_hash").agg(
        F.count(F.lit(1)).alias("exact_duplicate_groups"), F.coalesce(F.sum("surplus"), F.lit(0)).alias("total_duplicate_files"),
        F.count_if(F.bit_count("split_mask") > 1).alias("cross_split_groups"))
    near = near_pairs.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("near_duplicate_pairs"))

    def long(one: DataFrame) -> DataFrame:
        return one.select(F.explode(F.create_map(*[
            x for c in one.columns for x in (F.lit(c), F.col(c).cast("bigint"))])).alias("name", "value"))

    names = base.columns + groups.columns + near.columns
    joined = reduce(DataFrame.unionByName, [long(base), long(groups), long(near)])
    row = joined.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return row.withColumn("cross_split_leakage", F.col("cross_split_groups") > 0).drop("cross_split_groups")


# Severities in order.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def issue_ranking(summary: DataFrame, balance: DataFrame) -> DataFrame:
    """Issues found, most severe first. ``balance`` is the class balance per split."""
    valid = F.col("valid_images")

    def issue(order: int, severity: Column, name: str, amount: Column) -> Column:
        return F.when(severity.isNotNull(), F.struct(
            F.lit(order).alias("position"), severity.alias("severity"), F.lit(name).alias("issue"),
            amount.cast("double").alias("amount")))

    def graded(value: Column, limit: Column, above: str, below: str | None) -> Column:
        graded_ = F.when(value > limit, above)
        return graded_.when(value > 0, below) if below else graded_

    c = F.col
    rules = [
        issue(1, F.when(c("corrupt_images") > 0, "HIGH"), "corrupt files", c("corrupt_images")),
        issue(2, F.when(c("total_duplicate_files") > 0, "HIGH"), "exact duplicates", c("total_duplicate_files")),
        issue(3, F.when(c("cross_split_leakage"), "CRITICAL"), "cross-split leakage", F.lit(1)),
        issue(4, graded(c("near_duplicate_pairs"), F.lit(100), "HIGH", "MEDIUM"), "near duplicates", c("near_duplicate_pairs")),
        issue(5, graded(c("low_resolution_count"), valid * 0.01, "MEDIUM", "LOW"), "low resolution", c("low_resolution_count")),
        issue(6, graded(c("blurry_count"), valid * 0.05, "MEDIUM", "LOW"), "blurry", c("blurry_count")),
        issue(7, F.when(c("blank_count") > 0, "HIGH"), "blank", c("blank_count")),
        issue(9, graded(c("very_dark_count"), valid * 0.02, "LOW", None), "very dark", c("very_dark_count")),
        issue(10, graded(c("very_bright_count"), valid * 0.02, "LOW", None), "very bright", c("very_bright_count")),
        issue(11, graded(c("non_square_count"), valid * 0.1, "LOW", None), "non-square", c("non_square_count")),
    ]
    general = summary.select(F.explode(F.array_compact(F.array(*rules))).alias("i")).select("i.*")
    per_split = balance.select(
        F.lit(8).alias("position"),
        F.when(F.col("imbalance") > 0.10, "HIGH").when(F.col("imbalance") > 0.05, "MEDIUM").alias("severity"),
        F.concat(F.lit("class imbalance "), F.col("split")).alias("issue"),
        F.col("imbalance").alias("amount")).where(F.col("severity").isNotNull())
    found = general.unionByName(per_split)
    rank = F.array_position(F.lit(list(SEVERITIES)), F.col("severity"))
    # At most one row per rule and split: the order is over a handful of rows.
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(rank, "position", "issue"))
    return found.select(place.alias("place"), "severity", "issue", F.round("amount", 6).alias("amount")).orderBy("place")


def error_list(metrics: DataFrame) -> DataFrame:
    return metrics.where("is_corrupt").select("item_id", "split", "class", "error")


CUT_PARTS = 64


def head_per_list(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of every list, with their place.

    Every list is cut to ``n`` in CUT_PARTS parts first, whatever part a row is in,
    so the task that orders a list sees at most CUT_PARTS * n rows of it.
    """
    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)

    parts = cut(df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(CUT_PARTS))), *by, "_part")
    return cut(parts.drop("place", "_part"), *by)


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows with their rank; only they reach the ranking window."""
    cut = df.orderBy(*order).limit(k)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))
