"""Row-level expressions: path, geometry, quality, scoring and parsing rules.

Every function takes and returns Columns, so Catalyst sees the whole rule and
keeps it inside generated code. The same functions serve batch and streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from curatrix import conventions as cv


def rounded(value: Column, digits: int) -> Column:
    """Half up on the value scaled as a double, as SQL engines round doubles; ``F.round`` takes the shortest decimal instead, and 14.649999999999999 down."""
    scale = F.lit(float(10 ** digits))
    return F.round(value * scale) / scale


# --- paths and uploads -------------------------------------------------------

def path_segment(path: Column, names: Sequence[str]) -> Column:
    """The last path segment that is one of ``names``; null if none is."""
    parts = F.filter(F.split(path, "/"), lambda part: part.isin(*names))
    return F.try_element_at(parts, F.lit(-1))


def path_meta(path: Column) -> Column:
    return F.struct(
        path_segment(path, cv.SPLITS).alias("split"),
        path_segment(path, cv.CLASSES).alias("class"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# Accepted types and the size limit of an upload.
PHOTO_TYPES = ("image/jpeg", "image/png", "image/webp")
VIDEO_TYPES = ("video/mp4", "video/quicktime")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
NORMAL_MIME = ("image/png", "image/webp", "image/gif")


def is_accepted(mime: Column, size: Column, kind: str = "photo") -> Column:
    allowed = PHOTO_TYPES if kind == "photo" else VIDEO_TYPES
    return mime.isin(*allowed) & (size <= MAX_UPLOAD_BYTES)


def normal_mime(mime: Column) -> Column:
    low = F.lower(mime)
    return F.when(low.isin(*NORMAL_MIME), low).otherwise(F.lit("image/jpeg"))


def decode_upload(col: Column) -> Column:
    """Bytes of a base64 upload, with or without its data-URL prefix."""
    return F.unbase64(F.regexp_replace(col, r"^data:image/\w+;base64,", ""))


def content_hash(content: Column) -> Column:
    return F.md5(content)


# --- audit flags -------------------------------------------------------------

def aspect_ratio(width: Column, height: Column) -> Column:
    return width / F.nullif(height, F.lit(0))


def is_low_res(width: Column, height: Column) -> Column:
    return (width < cv.MIN_SIDE) | (height < cv.MIN_SIDE)


def is_non_square(aspect: Column) -> Column:
    return F.abs(aspect - 1.0) > cv.ASPECT_TOLERANCE


def is_blurry(blur: Column) -> Column:
    return blur < cv.BLUR_THRESHOLD


def is_blank(std: Column) -> Column:
    return std < cv.BLANK_THRESHOLD


def is_dark(brightness: Column) -> Column:
    return brightness < cv.DARK_THRESHOLD


def is_bright(brightness: Column) -> Column:
    return brightness > cv.BRIGHT_THRESHOLD


def impute_default(value: Column, default: float) -> Column:
    """A missing value replaced by a constant, with a mark that it was."""
    return F.struct(
        F.coalesce(value, F.lit(default)).alias("value"),
        value.isNull().alias("was_imputed"),
    )


# --- scores and verdicts -----------------------------------------------------

def sigmoid(logit: Column, temperature: float = 1.0) -> Column:
    scaled = logit if temperature == 1.0 else logit / F.lit(float(temperature))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-scaled))


def logit(p: Column, eps: float = 1e-6) -> Column:
    safe = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.ln(safe / (F.lit(1.0) - safe))


def calibrated_verdict(p: Column, threshold: float) -> Column:
    fake = p >= threshold
    conf = F.when(fake, p).otherwise(1.0 - p)
    wording = (
        F.when(fake & (conf > 0.8), "LIKELY DEEPFAKE")
        .when(fake & (conf > 0.6), "POSSIBLY DEEPFAKE")
        .when(~fake & (conf > 0.6), "LIKELY AUTHENTIC")
        .otherwise("INCONCLUSIVE")
    )
    return F.struct(
        fake.alias("is_fake"),
        rounded(conf * 100, 1).alias("confidence"),
        rounded(p * 100, 1).alias("probability_fake"),
        wording.alias("verdict"),
        rounded(p * 100, 1).alias("risk_score"),
    )


def risk_verdict(score: Column) -> Column:
    wording = (
        F.when(score >= 85, "LIKELY DEEPFAKE")
        .when(score >= 55, "POSSIBLY DEEPFAKE")
        .when(score >= 40, "INCONCLUSIVE")
        .otherwise("LIKELY AUTHENTIC")
    )
    return F.struct(
        (score >= 50).alias("is_fake"),
        F.least(F.greatest(score + 15, F.lit(50)), F.lit(95)).alias("confidence"),
        F.round(score).cast("bigint").alias("risk_score"),
        wording.alias("verdict"),
    )


def score_band(score: Column) -> Column:
    return F.when(score > 70, "danger").when(score >= 40, "warning").otherwise("safe")


# Fixed values: (signal, comparison, limit, points, name of the finding). Of the
# rules of one signal only the first that holds counts.
HEURISTIC_RULES = {
    "high_freq_ratio": ((">", 0.45, 25, "high-frequency pattern"), (">", 0.40, 15, "elevated high-frequency")),
    "low_var_ratio": ((">", 0.50, 30, "excessive uniformity"), (">", 0.35, 20, "local uniformity")),
    "peak_ratio": ((">", 0.15, 15, "color distribution peak"),),
    "edge_ratio": ((">", 0.25, 20, "irregular edges"),),
    "block_ratio": (("<", 0.10, 15, "compression artifacts"),),
    "symmetry_diff": (("<", 3.0, 10, "facial symmetry"),),
}


def heuristic_score(signals: dict[str, Column]) -> Column:
    """Points of all fired signals, capped at 100, and the list of findings."""
    points, findings = F.lit(0), []
    for name, rules in HEURISTIC_RULES.items():
        value, score, finding = signals[name], None, None
        for sign, limit, worth, text in rules:
            hit = value > limit if sign == ">" else value < limit
            score = F.when(hit, worth) if score is None else score.when(hit, worth)
            finding = F.when(hit, text) if finding is None else finding.when(hit, text)
        points = points + score.otherwise(0)
        findings.append(finding)
    return F.struct(
        F.least(points, F.lit(100)).alias("score"),
        F.filter(F.array(*findings), lambda f: f.isNotNull()).alias("signals"),
    )


def smooth_target(label: Column, fake_smooth: float = 0.05, real_smooth: float = 0.0) -> Column:
    """Asymmetric target: 1 - fake_smooth for Fake, real_smooth for Real."""
    return F.when(label == 1, F.lit(1.0 - fake_smooth)).otherwise(F.lit(float(real_smooth)))


def smooth_target_symmetric(label: Column, smoothing: float = 0.1) -> Column:
    return label * F.lit(1.0 - smoothing) + F.lit(0.5 * smoothing)


# --- metadata and second opinions --------------------------------------------

# Software names that point to generation, and to editing.
AI_TOOLS = ("midjourney", "dall-e", "dalle", "stable diffusion", "firefly", "generative fill", "ai", "topaz", "runway", "canva")
EDITORS = ("photoshop", "lightroom")


def metadata_flags(meta: Column, now: Column, recent_seconds: int = 60, is_video: Column | None = None, unreadable: Column | None = None) -> Column:
    """Findings on a metadata struct (software, make, model, latitude, longitude, captured_at).

    Names of AI tools match as whole words: ``ai`` does not fire inside ``mail``. Empty
    texts and zeros are absent values. A video has no such metadata, and metadata that
    cannot be read is a finding of its own.
    """
    software = F.nullif(meta["software"], F.lit(""))

    def absent(name: str) -> Column:
        return F.coalesce(meta[name].cast("string").isin("", "0", "0.0"), F.lit(True))

    low = F.lower(software)
    ai = low.rlike(r"(^|[^a-z0-9])(" + "|".join(AI_TOOLS) + r")([^a-z0-9]|$)")
    edited = low.rlike("|".join(EDITORS))
    age = F.unix_timestamp(now) - F.unix_timestamp(meta["captured_at"])
    flags = F.array(
        F.when(software.isNull(), None)
        .when(ai, F.concat(F.lit("ai software: "), software))
        .when(edited, F.lit("edited with image software"))
        .otherwise(F.concat(F.lit("software tag: "), software)),
        F.when(absent("make") | absent("model"), F.lit("no camera make/model")),
        F.when(absent("latitude") | absent("longitude"), F.lit("gps data absent")),
        F.when(meta["captured_at"].isNull(), F.lit("no original capture timestamp"))
        .when(age < recent_seconds, F.lit("created very recently")),
    )
    found = F.when(meta.isNull(), F.array(F.lit("no camera metadata"))).otherwise(F.filter(flags, lambda f: f.isNotNull()))
    if unreadable is not None:
        found = F.when(F.coalesce(unreadable, F.lit(False)), F.array(F.lit("metadata unreadable"))).otherwise(found)
    if is_video is not None:
        found = F.when(F.coalesce(is_video, F.lit(False)), F.array(F.lit("video: no image metadata"))).otherwise(found)
    return found


SECOND_OPINION = (
    "verdict string, confidence int, risk_score int, summary string, recommendation string, "
    "manipulation_metrics map<string,int>, signals map<string,struct<score:int,findings:array<string>>>, "
    "metadata_flags array<string>"
)


def answer_json(text: Column) -> Column:
    """The outermost object of an answer, without thinking blocks and code fences."""
    bare = F.regexp_replace(text, r"<think>[\s\S]*?</think>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"```json\s*", ""), r"```\s*", "")
    return F.nullif(F.regexp_extract(bare, r"\{[\s\S]*\}", 0), F.lit(""))


def parse_answer(text: Column, schema: str = SECOND_OPINION) -> Column:
    return F.from_json(answer_json(text), schema)
