"""Lanczos resizing against the definition, term by term."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from curatrix.functions.bits import signed
from curatrix.operators import pixels as px


def one_axis(row, target):
    out, scale = [], len(row) / target
    widen = max(scale, 1)
    for i in range(target):
        centre, terms = (i + 0.5) * scale, []
        for k in range(max(0, math.floor(centre - 3 * widen + 0.5)), min(len(row), math.floor(centre + 3 * widen + 0.5))):
            t = (k + 0.5 - centre) / widen
            a, b = math.pi * t, math.pi * t / 3
            terms.append((1.0 if t == 0 else math.sin(a) / a * math.sin(b) / b if abs(t) < 3 else 0.0, row[k]))
        mean = sum(w * v for w, v in terms) / sum(w for w, _ in terms)
        out.append(min(255, max(0, math.floor(round(mean, 6) + 0.5))))
    return out


@pytest.mark.parametrize("shape, target", [((40, 31), (8, 9)), ((5, 3), (8, 9)), ((1, 1), (8, 9)), ((100, 7), (16, 16)), ((8, 9), (8, 9))])
def test_against_the_definition(shape, target):
    values = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    rows = [one_axis(r, target[1]) for r in values.tolist()]
    want = [one_axis(c, target[0]) for c in zip(*rows)]
    assert px.lanczos_resize(values, *target).T.astype(int).tolist() == want


def test_flat_and_same_size():
    flat = np.full((20, 30), 77)
    assert (px.lanczos_resize(flat, 8, 9) == 77).all()
    own = np.arange(72).reshape(8, 9)
    assert (px.lanczos_resize(own, 8, 9) == own).all()


def test_by_parameter(spark):
    data = np.random.default_rng(1).integers(0, 256, (30, 20, 3), np.uint8)
    schema = "item_id long, height int, width int, nChannels int, data binary, file_size long"
    images = spark.createDataFrame([(1, 30, 20, 3, data.tobytes(), 10), (2, None, None, None, None, 0)], schema)
    g = px.grey(data)
    for name, resize in px.RESIZERS.items():
        row, none = sorted(px.pixel_features(images, ["basic", "blur"], resample=name, side=32).collect())
        assert row.dhash == px.dhash(g, resize) and row.blur_score == pytest.approx(px.laplacian(resize(g, 32, 32)).var())
        assert none.dhash is None and none.blur_score is None


def exact_dhash(values):
    """Area means as fractions, from the definition."""
    height, width = values.shape

    def share(source, target):
        return [[max(Fraction(0), min(Fraction((i + 1) * source, target), k + 1) - max(Fraction(i * source, target), k)) for k in range(source)] for i in range(target)]

    down, across = share(height, 8), share(width, 9)
    rows = [[sum(w * int(v) for w, v in zip(shares, column) if w) for column in values.T] for shares in down]
    cells = [[sum(w * v for w, v in zip(shares, row) if w) for shares in across] for row in rows]
    return signed(int("".join("1" if a > b else "0" for row in cells for a, b in zip(row, row[1:])), 2))


@pytest.mark.parametrize("height, unit", [(64, b"same "), (64, b"a "), (8, b"ab "), (23, b"one two "), (400, b"same ")])
def test_hash_of_equal_cells(height, unit):
    """Cells with equal means give no bit, whatever the order of summing."""
    g = px.grey(px.to_array(height, 48, 3, (unit * 144 * height)[:height * 144]))
    assert px.dhash(g) == exact_dhash(g)


@pytest.mark.parametrize("resample", ["area", "lanczos"])
def test_hash_family_is_the_hash_of_basic(spark, resample):
    rng = np.random.default_rng(4)
    rows = [(i, 5 + i % 40, 48, 3, rng.integers(0, 256, (5 + i % 40) * 144).astype(np.uint8).tobytes(), 9) for i in range(60)] + [(60, None, 48, 3, None, None)]
    images = spark.createDataFrame(rows, "item_id bigint, height int, width int, nChannels int, data binary, file_size bigint")
    got, want = ({r.item_id: r.dhash for r in px.pixel_features(images, f, resample=resample).collect()} for f in ("hash", "basic"))
    assert got == want and len(got) == 61 and got[60] is None and px.pixel_features(images, "hash").columns == ["item_id", "dhash"]


def test_forensics_of_one_image_do_not_depend_on_the_one_before():
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (h, 48, 3)).astype(np.uint8) for h in (3, 300, 40)]
    alone = []
    for image in images:
        px.working_space.cache_clear()
        alone.append(px.forensic_signals(image, 1))
    assert [px.forensic_signals(image, 1) for image in images] == alone


def test_tables_of_weights_are_bounded(monkeypatch):
    """Kept weights and running sums say the same; long axes keep nothing."""
    values = np.random.default_rng(6).integers(0, 256, (50, 48))
    kept = px.area_resize(values, 8, 9)
    monkeypatch.setattr(px, "KEPT_CELLS", 0)
    px.area_weights.cache_clear()
    assert (px.area_resize(values, 8, 9) == kept).all() and px.area_weights.cache_info().currsize == 0
