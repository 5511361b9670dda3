"""Pixel features: the one place where Python touches the data.

Input is a table of decoded images with the columns of Spark's image source
(height, width, nChannels, data in BGR order). ``mapInArrow`` hands batches
of them to small NumPy helpers, which see the pixels where the batch has them, and returns one flat row per image; everything
after that works on the feature table. Spark bounds the batches by bytes
(spark.sql.execution.arrow.maxBytesPerBatch), whatever the size of an image. Hashes use an area-mean resize, so they
agree in meaning with other resize filters, not bit for bit.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix import conventions as cv
from curatrix.functions.bits import signed


#: Cells of a table of resize weights that is kept for further images of its size, and how many of these are kept.
KEPT_CELLS, KEPT_TABLES = 1 << 14, 128
#: Images whose features go out together.
IMAGES_OUT = 1000


# --- helpers on one image ----------------------------------------------------

def to_array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Height x width x 3, BGR, one byte per value."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(pixels, 3, axis=2)
    return pixels[:, :, :3]


def grey(bgr: np.ndarray) -> np.ndarray:
    """Luma in 16-bit fixed point, rounded."""
    b, g, r = (bgr[:, :, i].astype(np.int64) for i in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 32768) >> 16


@lru_cache(KEPT_TABLES)
def area_weights(source: int, target: int) -> np.ndarray:
    """Target by source: how much of every source cell, of ``target`` parts, a target cell covers."""
    edges, at = np.arange(target + 1) * source, np.arange(source)[None, :] * target
    return np.clip(np.minimum(edges[1:, None], at + target) - np.maximum(edges[:-1, None], at), 0, None).astype(np.float64)


def area_sums(values: np.ndarray, target: int) -> np.ndarray:
    """Sums over the span that every target cell covers along the first axis, times ``target``, so whole numbers stay whole: by
    kept weights or, where these are many, by running sums."""
    source = values.shape[0]
    if values.ndim == 2 and source * target <= KEPT_CELLS:
        return area_weights(source, target) @ values
    edges = np.arange(target + 1) * source
    whole = np.minimum(edges // target, source - 1)
    part = (edges - whole * target).reshape(-1, *[1] * (values.ndim - 1))
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return np.diff(target * sums[whole] + part * values[whole], axis=0)


def area_resize(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area every target cell covers; cells with equal sums are equal."""
    sums = area_sums(area_sums(values.swapaxes(0, 1), width).swapaxes(0, 1), height)
    return sums / (values.shape[0] * values.shape[1])


def lanczos_weights(source: int, target: int, lobes: int = 3) -> np.ndarray:
    """Target by source weights of a windowed sinc. Downsizing widens the window by the scale; the weights of a target add up to one."""
    scale = source / target
    widen = max(scale, 1.0)
    centre = ((np.arange(target) + 0.5) * scale)[:, None]
    at = np.arange(source)[None, :]
    reach = lobes * widen
    inside = (at >= np.floor(centre - reach + 0.5)) & (at < np.floor(centre + reach + 0.5))
    t = (at + 0.5 - centre) / widen
    weights = np.where(inside & (np.abs(t) < lobes), np.sinc(t) * np.sinc(t / lobes), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


kept_lanczos_weights = lru_cache(KEPT_TABLES)(lanczos_weights)


def lanczos_resize(values: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rows first, then columns, each rounded to whole numbers of one byte. Sums are cut to six decimals before, so that halves round alike."""
    for size in (width, height):
        weights = kept_lanczos_weights if values.shape[1] * size <= KEPT_CELLS else lanczos_weights
        mixed = np.round(values @ weights(values.shape[1], size).T, 6)
        values = np.clip(np.floor(mixed + 0.5), 0, 255).T
    return values


RESIZERS: dict[str, Callable[[np.ndarray, int, int], np.ndarray]] = {"area": area_resize, "lanczos": lanczos_resize}


def laplacian(values: np.ndarray) -> np.ndarray:
    """3x3 Laplacian with a border of zeros."""
    p = np.pad(values.astype(np.float64), 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]


def sobel_magnitude(values: np.ndarray) -> np.ndarray:
    p = np.pad(values.astype(np.float64), 1, mode="edge")
    gx = (p[:-2, 2:] - p[:-2, :-2]) + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + (p[2:, 2:] - p[2:, :-2])
    gy = (p[2:, :-2] - p[:-2, :-2]) + 2 * (p[2:, 1:-1] - p[:-2, 1:-1]) + (p[2:, 2:] - p[:-2, 2:])
    return np.sqrt(gx * gx + gy * gy)


def gaussian5(values: np.ndarray) -> np.ndarray:
    """5x5 binomial blur, borders mirrored without the edge pixel."""
    taps = np.array([1, 4, 6, 4, 1]) / 16
    mode = "reflect" if min(values.shape) > 2 else "edge"
    p = np.pad(values.astype(np.float64), 2, mode=mode)
    rows = sum(t * p[i:p.shape[0] - 4 + i, :] for i, t in enumerate(taps))
    return sum(t * rows[:, i:rows.shape[1] - 4 + i] for i, t in enumerate(taps))


def dct_basis() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos(np.pi * (2 * n + 1) * k / 16) * 0.5
    basis[0] /= np.sqrt(2)
    return basis


def blocks_of(values: np.ndarray) -> np.ndarray:
    """8x8 blocks whose far edge lies inside the image; the last row and column of blocks is left out."""
    rows, cols = max(values.shape[0] - 1, 0) // 8, max(values.shape[1] - 1, 0) // 8
    cut = values[:rows * 8, :cols * 8]
    return cut.reshape(rows, 8, cols, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)


def dhash(g: np.ndarray, resize: Callable[[np.ndarray, int, int], np.ndarray] = area_resize) -> int:
    small = np.round(resize(g, 8, 9), 6)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return signed(int.from_bytes(np.packbits(bits).tobytes(), "big"))


def exact_variance(values: np.ndarray) -> float:
    """Population variance of whole numbers, from whole-number sums."""
    whole = values.astype(np.int64).ravel()
    n, total = len(whole), int(whole.sum())
    return (n * int((whole * whole).sum()) - total * total) / (n * n)


# --- feature families --------------------------------------------------------

def basic_features(bgr: np.ndarray, file_size: int, resize=area_resize) -> dict:
    g = grey(bgr)
    return {
        "brightness": float(g.mean()),
        "pixel_std": float(bgr.std()),
        "dhash": dhash(g, resize),
    }


def hash_features(bgr: np.ndarray, file_size: int, resize=area_resize) -> dict:
    return {"dhash": dhash(grey(bgr), resize)}


def blur_features(bgr: np.ndarray, file_size: int, side: int = 224, resize=area_resize) -> dict:
    return {"blur_score": float(laplacian(resize(grey(bgr), side, side)).var())}


def artifact_features(bgr: np.ndarray, file_size: int) -> dict:
    g = grey(bgr)
    h, w = g.shape
    parts = blocks_of(g.astype(np.float64))
    basis = dct_basis()
    energy = np.abs(basis @ parts @ basis.T)[:, 1:, 1:].sum(axis=(1, 2)) if len(parts) else np.zeros(1)
    middle = g[h // 2 - h // 6:h // 2 + h // 6, w // 2 - w // 6:w // 2 + w // 6]
    top, bottom = bgr.max(axis=2).astype(np.float64), bgr.min(axis=2).astype(np.float64)
    saturation = np.where(top > 0, np.rint(255 * (top - bottom) / np.maximum(top, 1)), 0)
    return {
        "laplacian_var": exact_variance(laplacian(g)),
        "avg_dct_energy": float(energy.mean()),
        "skin_smoothness_std": float(np.sqrt(exact_variance(middle))) if middle.size else 0.0,
        "edge_density_pct": float((sobel_magnitude(g) > 150).mean() * 100),
        "brightness": float(g.mean()),
        "contrast": float(np.sqrt(exact_variance(g))),
        "saturation": float(saturation.mean()),
        "noise_level": float(np.abs(g - gaussian5(g)).mean()),
        "file_size_kb": file_size / 1024,
    }


@lru_cache(2)
def working_space(side: int) -> SimpleNamespace:
    """Arrays that one image after the other is worked out in: making them anew takes longer than filling them."""
    at = np.arange(0, side - 1, 2)
    y, x = at[:, None], at[None, :]
    low = (x < side / 3) | (y < side / 3)
    n = max(side - 1, 0) // 8
    return SimpleNamespace(
        mean=np.empty((side, side)), quarter=np.empty((side, side)), bins=np.empty((side, side), np.int64), apart=np.empty((n, 8, n, 8)),
        across=np.empty((len(at), len(at))), down=np.empty((len(at), len(at))), high=~low & ((x > side * 2 / 3) | (y > side * 2 / 3)))


def forensic_signals(bgr: np.ndarray, file_size: int, side: int = 256) -> dict:
    kept = working_space(side)
    # Rounded, so that values on a limit do not depend on the order of summing.
    mean = np.round(area_resize(bgr.mean(axis=2), side, side), 6, out=kept.mean)
    here = mean[:-1:2, :-1:2]
    change = np.abs(np.subtract(here, mean[:-1:2, 1::2], out=kept.across), out=kept.across)
    change += np.abs(np.subtract(here, mean[1::2, :-1:2], out=kept.down), out=kept.down)
    n = max(side - 1, 0) // 8
    regions = mean[:n * 8, :n * 8].reshape(n, 8, n, 8)
    # Sums go down the rows of blocks first, which is along the memory.
    centre = regions.sum(axis=1).sum(axis=2) / 64
    apart = np.subtract(regions, centre[:, None, :, None], out=kept.apart)
    variance = np.multiply(apart, apart, out=apart).sum(axis=1).sum(axis=2) / 64
    np.copyto(kept.bins, np.multiply(mean, 0.25, out=kept.quarter), casting="unsafe")
    bins = np.bincount(kept.bins.ravel(), minlength=64)
    near = {(dy, dx): mean[2 + dy:side - 2 + dy:4, 2 + dx:side - 2 + dx:4] for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    gx = sum(w * (near[dy, 1] - near[dy, -1]) for dy, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (near[1, dx] - near[-1, dx]) for dx, w in ((-1, 1), (0, 2), (1, 1)))
    edges = np.round(np.hypot(gx, gy), 4)
    # Of the red channel only every eighth row is looked at.
    grid = np.arange(8, side - 8, 8)
    red = np.round(area_sums(area_sums(bgr[:, :, 2], side)[grid].T, side) / bgr[:, :, 2].size, 6)
    jumps = np.abs(red[grid] - red[grid + 1]).T
    left = mean[::4, :side // 2:4]
    right = mean[::4, ::-1][:, :side // 2:4]
    return {
        "high_freq_ratio": float(change[kept.high].sum() / (change.sum() + 1)),
        "low_var_ratio": float((variance < 100).mean()),
        "peak_ratio": float(bins.max() / mean.size),
        "edge_ratio": float(((edges > 50) & (edges < 100)).mean()),
        "block_ratio": float((jumps > 20).sum() / variance.size),
        "symmetry_diff": float(np.abs(np.subtract(left, right, order="F")).mean()),
    }


def residual_features(bgr: np.ndarray, file_size: int, weight: float = 0.3) -> dict:
    """High-pass residual per channel, and the image with ``weight`` of it added."""
    residual = np.stack([-laplacian(bgr[:, :, i]) for i in range(3)], axis=2) / 255
    boosted = bgr / 255 + weight * residual
    return {
        "residual_abs_mean": float(np.abs(residual).mean()),
        "residual_std": float(residual.std()),
        "boosted_mean": float(boosted.mean()),
        "boosted_std": float(boosted.std()),
    }


FAMILIES: dict[str, tuple[Callable[[np.ndarray, int], dict], str]] = {
    "basic": (basic_features, "brightness double, pixel_std double, dhash bigint"),
    "hash": (hash_features, "dhash bigint"),
    "blur": (blur_features, "blur_score double"),
    "artifacts": (artifact_features,
                  "laplacian_var double, avg_dct_energy double, skin_smoothness_std double, edge_density_pct double, "
                  "brightness double, contrast double, saturation double, noise_level double, file_size_kb double"),
    "forensics": (forensic_signals,
                  "high_freq_ratio double, low_var_ratio double, peak_ratio double, edge_ratio double, "
                  "block_ratio double, symmetry_diff double"),
    "residual": (residual_features, "residual_abs_mean double, residual_std double, boosted_mean double, boosted_std double"),
}

PIXEL_COLUMNS = ("height", "width", "nChannels", "data", "file_size")


ARROW_TYPES = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
               "array<float>": pa.list_(pa.float32())}


def _per_image(df: DataFrame, carry: Sequence[str], schema: str, work: Callable[..., dict]) -> DataFrame:
    """Run ``work(row)`` over Arrow batches, with the pixels as a buffer of the batch; rows without pixels get nulls."""
    made = [part.strip().split(" ") for part in schema.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    given = list(dict.fromkeys([*carry, *PIXEL_COLUMNS]))
    # Helpers read these by name, and of what is carried the seed of a draw.
    read = [*PIXEL_COLUMNS, *(c for c in carry if c == "draw")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = namedtuple("image", read)
        for batch in batches:
            for part in (batch.slice(at, IMAGES_OUT) for at in range(0, batch.num_rows, IMAGES_OUT)):
                columns = dict(zip(given, part.columns))
                held = [[v.as_buffer() for v in columns[c]] if c == "data" else columns[c].to_pylist() for c in read]
                rows = [work(r) if r.data is not None and r.height is not None and r.height > 0 else None for r in map(image, *held)]
                yield pa.RecordBatch.from_arrays(
                    [*(columns[c] for c in carry), *(pa.array([r and r[n] for r in rows], ARROW_TYPES[t]) for n, t in made)],
                    [*carry, *(n for n, _ in made)])

    carried = ", ".join(f"`{c}` {types[c]}" for c in carry)
    return df.select(*given).mapInArrow(run, f"{carried}, {schema}")


def pixel_features(images: DataFrame, families: str | Sequence[str], carry: Sequence[str] = ("item_id",), side: int | None = None,
                   resample: str = "area") -> DataFrame:
    """One flat feature row per image; families: basic, hash, blur, artifacts, forensics, residual.

    Several families share one pass over the pixels; a column that two of them
    have comes once. ``side`` is the size that blur and forensics resize to, where
    it is not their own. ``resample`` is how hashes and blur resize: ``area`` (mean of the area) or ``lanczos`` (three lobes).
    """
    chosen = [families] if isinstance(families, str) else list(families)
    helpers = [FAMILIES[f][0] for f in chosen]
    schema = ", ".join(dict.fromkeys(part for f in chosen for part in FAMILIES[f][1].split(", ")))

    def work(r) -> dict:
        bgr, out = to_array(r.height, r.width, r.nChannels, r.data), {}
        for helper in helpers:
            sized = side is not None and helper in (blur_features, forensic_signals)
            options = {"resize": RESIZERS[resample]} if helper in (basic_features, hash_features, blur_features) else {}
            out |= helper(bgr, r.file_size, side, **options) if sized else helper(bgr, r.file_size, **options)
        return out

    return _per_image(images, carry, schema, work)


def feature_vectors(images: DataFrame, size: int = 8, carry: Sequence[str] = ("item_id",)) -> DataFrame:
    """Resized pixels in RGB order, scaled to [0, 1] and normalised per channel, as ``array<float>``."""
    mean, std = np.array(cv.CHANNEL_MEAN), np.array(cv.CHANNEL_STD)

    def work(r) -> dict:
        rgb = area_resize(to_array(r.height, r.width, r.nChannels, r.data)[:, :, ::-1], size, size) / 255
        return {"vector": ((rgb - mean) / std).transpose(2, 0, 1).ravel().astype(np.float32)}

    return _per_image(images, carry, "vector array<float>", work)


def augment(images: DataFrame, seed: int, kinds: Sequence[str] = ("blur", "low_light", "contrast", "flip"), carry: Sequence[str] = ("item_id",)) -> DataFrame:
    """One altered copy per image; kind and strength follow from the seed and the item, not from the run."""
    seeded = images.withColumn("draw", F.xxhash64(F.col(carry[0]), F.lit(seed)))
    keep = [*carry, "draw"]

    def work(r) -> dict:
        rng = np.random.default_rng(int(r.draw) & 0x7FFFFFFFFFFFFFFF)
        kind = kinds[int(rng.integers(len(kinds)))]
        bgr = to_array(r.height, r.width, r.nChannels, r.data).astype(np.float64)
        if kind == "blur":
            bgr = np.stack([gaussian5(bgr[:, :, i]) for i in range(3)], axis=2)
        elif kind == "low_light":
            dim = bgr * rng.uniform(0.4, 0.75)
            bgr = dim.mean() + (dim - dim.mean()) * rng.uniform(0.8, 1.0)
        elif kind == "contrast":
            bgr = bgr.mean() + (bgr - bgr.mean()) * rng.uniform(0.85, 1.15)
            shade = bgr.mean(axis=2, keepdims=True)
            bgr = shade + (bgr - shade) * rng.uniform(1.1, 1.4)
        elif kind == "flip":
            bgr = bgr[:, ::-1]
        else:
            raise ValueError(kind)
        out = np.clip(np.rint(bgr), 0, 255).astype(np.uint8)
        return {"kind": kind, "out_height": out.shape[0], "out_width": out.shape[1], "out_data": out.tobytes()}

    made = _per_image(seeded, keep, "kind string, out_height int, out_width int, out_data binary", work)
    return made.select(*carry, "kind", F.col("out_height").alias("height"), F.col("out_width").alias("width"),
                       F.lit(3).alias("nChannels"), F.col("out_data").alias("data"),
                       F.length("out_data").cast("bigint").alias("file_size"))
