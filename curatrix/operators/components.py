"""Duplicate graph: components that span splits, who stays and who is quarantined.

Items never enter the iteration. Its nodes are *sites*, the items of one
fingerprint in one split, and exact-copy groups; both are named by their smallest
item id. All copies at a site share their neighbours, so the graph has the same
components as the graph of all item pairs, at the size of the distinct content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.operators.forest import cross_split_forest
from curatrix.operators.profile import one_of
from curatrix.operators.skew import lookup_join
from curatrix.session import materialize


# --- connected components ----------------------------------------------------

def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each round
    links nodes to the smallest neighbour known, and the number of rounds grows
    with the logarithm of the graph. Each round is written to the shared folder.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        if current.isEmpty():
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the joins have exchanges of their own and a hub's large partition is split.
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        root = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "roots")
        small = (
            large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(root.select("u", F.col("m").alias("v")))
            .distinct()
        )
        current = materialize(small, "stars")
        if _is_star_forest(current):
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def _is_star_forest(stars: DataFrame) -> bool:
    """Every node has one parent and no parent has one itself."""
    climbing = stars.select(F.col("v").alias("u")).distinct().join(stars.select("u").distinct(), "u", "left_semi")
    twice = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    return climbing.unionByName(twice).isEmpty()


# --- the duplicate graph -----------------------------------------------------

def spanning_groups(items: DataFrame, key: str = "content_md5") -> DataFrame:
    """Exact-copy groups over more than one split: key, smallest id, size."""
    return (
        items.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.min("item_id").alias("copy_node"), F.count(F.lit(1)).alias("copies"),
             F.bit_or(one_of(cv.SPLITS, "split")).alias("_splits"))
        .where("bit_count(_splits) > 1").drop("_splits")
    )


def duplicate_graph(items: DataFrame, blocks: DataFrame, exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between nodes, and the sites that near-duplicates touch (fp, split, node, n)."""
    def side(s: str) -> DataFrame:
        return blocks.select(F.col(f"fp_{s}").alias("fp"), F.col(f"split_{s}").alias("split")).distinct()

    touched = side("a").unionByName(side("b")).distinct()
    sites = (
        items.where(F.col("fp").isNotNull()).groupBy("fp", "split")
        .agg(F.min("item_id").alias("node"), F.count(F.lit(1)).alias("n"))
        .join(touched, ["fp", "split"], "left_semi")
    )

    def named(s: str) -> DataFrame:
        return sites.select(F.col("fp").alias(f"fp_{s}"), F.col("split").alias(f"split_{s}"), F.col("node").alias(s))

    near = (
        blocks.select("fp_a", "split_a", "fp_b", "split_b").distinct()
        .join(named("a"), ["fp_a", "split_a"]).join(named("b"), ["fp_b", "split_b"]).select("a", "b")
    )
    return near.unionByName(_chained(items, sites, exact)).distinct(), sites


def _chained(items: DataFrame, sites: DataFrame, exact: DataFrame) -> DataFrame:
    """Edges from sites to the exact-copy groups that they hold members of."""
    occurs = items.where(F.col("fp").isNotNull()).groupBy("content_md5", "fp", "split").agg(F.count(F.lit(1)).alias("_k"))
    return (
        occurs.join(exact.select("content_md5", "copy_node"), "content_md5")
        .join(sites.select("fp", "split", "node"), ["fp", "split"])
        .select(F.col("node").alias("a"), F.col("copy_node").alias("b"))
    )


def forest_graph(items: DataFrame, exact: DataFrame, distance: int = cv.NEAR_DUP_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """As ``duplicate_graph``, with the same components but no pairs: edges grow with the distinct fingerprints, not with their pairs."""
    touched, forest = cross_split_forest(items, distance)
    sites = materialize(
        items.where(F.col("fp").isNotNull() & F.col("split").isin(*cv.SPLITS)).groupBy("fp", "split")
        .agg(F.min("item_id").alias("node"), F.count(F.lit(1)).alias("n")).join(touched, "fp", "left_semi"), "sites")
    first = materialize(sites.groupBy("fp").agg(F.min("node").alias("first")), "first-sites")

    def end(s: str) -> DataFrame:
        return first.select(F.col("fp").alias(s), F.col("first").alias(f"first_{s}"))

    near = forest.join(end("a"), "a").join(end("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    # All sites of a fingerprint that several splits have are linked to each other.
    star = sites.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return near.unionByName(star).unionByName(_chained(items, sites, exact)).distinct(), sites


def duplicate_components(items: DataFrame, blocks: DataFrame | None = None, distance: int = cv.NEAR_DUP_DISTANCE) -> DataFrame:
    """(item_id, split, class, component) for every item in a component over more than one split.

    ``items``: item_id, split, class, content_md5, fp. ``component`` is the
    smallest item id in it. Without ``blocks`` no pair is written: each bucket gives a
    spanning forest of its near fingerprints.
    """
    exact = materialize(spanning_groups(items), "spanning")
    if blocks is None:
        edges, sites = forest_graph(items, exact, distance)
    else:
        edges, sites = duplicate_graph(items, blocks, exact)
        sites = materialize(sites, "sites")
    labels = materialize(connected_components(edges), "components")
    members = items.select("item_id", "split", "class", "content_md5", "fp")
    by_site = sites.join(labels, "node", "left").select("fp", "split", F.coalesce("component", "node").alias("component"), "n")
    near = lookup_join(members, by_site, ["fp", "split"], "n")

    # Copies away from any touched site (no fingerprint, or one that differs) hang on their copy group.
    covered = (
        items.where(F.col("fp").isNotNull()).groupBy("content_md5", "fp", "split").agg(F.count(F.lit(1)).alias("_k"))
        .join(sites.select("fp", "split"), ["fp", "split"], "left_semi")
        .groupBy("content_md5").agg(F.sum("_k").alias("_covered"))
    )
    loose = exact.join(covered, "content_md5", "left").where(F.coalesce("_covered", F.lit(0)) < F.col("copies"))
    by_copy = loose.join(labels, loose["copy_node"] == labels["node"], "left").select(
        "content_md5", F.coalesce("component", "copy_node").alias("component"), F.col("copies").alias("n"))
    copied = lookup_join(members, by_copy, ["content_md5"], "n").join(sites.select("fp", "split"), ["fp", "split"], "left_anti")
    columns = ["item_id", "split", "class", "component"]
    return near.select(*columns).unionByName(copied.select(*columns))


def _priority(split: Column, order: Sequence[str]) -> Column:
    rank = F.when(split == order[0], 0)
    for i, name in enumerate(order[1:], 1):
        rank = rank.when(split == name, i)
    return rank.otherwise(len(order))


def component_summary(members: DataFrame, order: Sequence[str] = cv.KEEP_PRIORITY) -> DataFrame:
    """Per component: size, number of splits and the item that stays (best split first, then smallest id)."""
    first = [f"_first_{i}" for i in range(len(order))]
    grouped = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.min(F.when(F.col("split") == s, F.col("item_id"))).alias(c) for s, c in zip(order, first)])
    best = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(first)])
    return grouped.select(
        "component", "n_items",
        F.struct(best.alias("rank"), F.coalesce(*first).alias("item_id")).alias("keep"),
        sum((F.col(c).isNotNull().cast("int") for c in first), F.lit(0)).alias("n_splits"))


def quarantine(members: DataFrame, order: Sequence[str] = cv.KEEP_PRIORITY, keep: str = "one") -> DataFrame:
    """Items to take out so that no component touches two splits.

    ``keep="one"`` leaves one item per component; ``keep="best_split"`` leaves all
    members of its best split.
    """
    chosen = component_summary(members, order).where("n_splits > 1").select("component", "keep", "n_items")
    joined = lookup_join(members, chosen, ["component"], "n_items")
    if keep == "one":
        out = joined.where(F.col("item_id") != F.col("keep.item_id"))
    elif keep == "best_split":
        out = joined.where(_priority(F.col("split"), order) > F.col("keep.rank"))
    else:
        raise ValueError(keep)
    return out.select("item_id", "split", "class", "component", F.col("keep.item_id").alias("kept_id"))


def removal_report(removed: DataFrame, items: DataFrame) -> DataFrame:
    totals = items.groupBy("split", "class").agg(F.count(F.lit(1)).alias("total"))
    gone = removed.groupBy("split", "class").agg(F.count(F.lit(1)).alias("removed"))
    return totals.join(gone, ["split", "class"], "left").select(
        "split", "class", F.coalesce("removed", F.lit(0)).alias("removed"), "total")


def dedup_summary(items: DataFrame, blocks: DataFrame, members: DataFrame, removed: DataFrame) -> DataFrame:
    """Pairs, edges, components and quarantined items in one row."""
    def fact(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("v")).select(F.lit(name).alias("k"), "v")

    facts = (
        fact(blocks, "pairs", F.sum("n_pairs"))
        .unionByName(fact(spanning_groups(items), "chain", F.sum(F.col("copies") - 1)))
        .unionByName(fact(component_summary(members), "components", F.count_if(F.col("n_splits") > 1)))
        .unionByName(fact(removed, "quarantined", F.count(F.lit(1))))
    )

    def pick(name: str) -> Column:
        return F.max(F.when(F.col("k") == name, F.col("v")))

    return facts.agg(
        pick("pairs").alias("pairs_loaded"), (pick("pairs") + pick("chain")).alias("edges_used"),
        pick("components").alias("components_spanning_splits"), pick("quarantined").alias("files_quarantined"))
