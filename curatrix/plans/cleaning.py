"""Whole flows: audit a data set, find leakage, clean the training set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions import scalar as sc
from curatrix.operators import components as comp
from curatrix.operators import pixels as px
from curatrix.operators import profile as pr
from curatrix.operators.labels import apply_corrections, exclude
from curatrix.operators.neardup import near_dup_blocks
from curatrix.session import materialize
from curatrix.sources import images as im


@dataclass
class LeakageResult:
    """Tables of one leakage run, all written once and cheap to query again. Pairs are only counted where a summary asks for them."""

    items: DataFrame
    distance: int
    members: DataFrame
    removed: DataFrame

    def summary(self) -> DataFrame:
        return comp.dedup_summary(self.items, self.blocks(), self.members, self.removed)

    def blocks(self) -> DataFrame:
        return near_dup_blocks(self.items, self.distance, "cross_split")

    def report(self) -> DataFrame:
        return comp.removal_report(self.removed, self.items)


def find_leakage(items: DataFrame, distance: int = cv.NEAR_DUP_DISTANCE, keep: str = "one") -> LeakageResult:
    """Components of near and exact copies across splits, and what to quarantine.

    ``items``: item_id, split, class, content_md5, fp. It is written first, so
    whatever computed the fingerprints runs once.
    """
    items = materialize(items.select("item_id", "split", "class", "content_md5", "fp"), "items")
    members = materialize(comp.duplicate_components(items, distance=distance), "members")
    removed = materialize(comp.quarantine(members, keep=keep), "removed")
    return LeakageResult(items, distance, members, removed)


def clean_items(items: DataFrame, removed: DataFrame, flips: DataFrame | None = None, label: str = "label") -> DataFrame:
    """Items without the quarantined ones, labels corrected where a manifest says so."""
    kept = exclude(items, removed)
    return kept if flips is None else apply_corrections(kept, flips, label)


def folder_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The metric table of an image folder, with fingerprints: pixels become features where they are read, and only
    narrow rows meet the content hashes."""
    images = im.scan_images(spark, root)
    carried = ("path", "split", "class", "height", "width", "file_size", "is_corrupt", "error")
    features = px.pixel_features(images, ["basic", "blur"], carry=carried)
    c = F.col
    return materialize(
        features.join(im.content_hashes(spark, root), "path", "left").select(
            c("path").alias("item_id"), "split", "class", "width", "height", sc.aspect_ratio(c("width"), c("height")).alias("aspect_ratio"),
            "file_size", "brightness", "blur_score", c("content_md5").alias("file_hash"), "pixel_std", c("dhash").alias("fp"),
            *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in (
                ("is_low_res", sc.is_low_res(c("width"), c("height"))), ("is_blurry", sc.is_blurry(c("blur_score"))), ("is_blank", sc.is_blank(c("pixel_std"))),
                ("is_dark", sc.is_dark(c("brightness"))), ("is_bright", sc.is_bright(c("brightness"))),
                ("is_non_square", sc.is_non_square(sc.aspect_ratio(c("width"), c("height")))))],
            "is_corrupt", "error"), "folder-metrics")


def audit_folder(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """From a folder of image files to all tables of an audit."""
    metrics = folder_metrics(spark, root)
    return run_audit(metrics, near_dup_blocks(metrics.where("fp IS NOT NULL"), scope="same_split_class"))


def run_audit(metrics: DataFrame, near_pairs: DataFrame) -> dict[str, DataFrame]:
    """All tables of a data set audit over one metric table, which is read, not recomputed."""
    ok = metrics.where(~F.col("is_corrupt"))
    groups = pr.exact_dup_groups(ok, "file_hash")
    summary = pr.audit_summary(metrics, near_pairs)
    balance = pr.class_balance(ok)
    return {
        "summary": summary,
        "issues": pr.issue_ranking(summary, balance),
        "counts": pr.counts(ok),
        "profile": pr.profile(ok),
        "flags": pr.flag_rates(metrics),
        "balance": balance,
        "exact_duplicates": pr.exact_dup_members(ok.select("item_id", "split", "class", "file_hash"), "file_hash"),
        "cross_split": pr.cross_split_exact(groups),
        "near_duplicates": near_pairs,
        "errors": pr.error_list(metrics),
    }
