"""Image folders, pixel features against slow loops, readers and writers."""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.operators import investigate as inv
from curatrix.operators import pixels as px
from curatrix.plans.cleaning import audit_folder
from curatrix.sources import images as im
from curatrix.sources import reports as rp


def png(rgb: np.ndarray) -> bytes:
    """A minimal PNG file of an RGB array."""
    h, w, _ = rgb.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("Dataset")
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, (80, 96, 3))
    slope = np.tile(np.linspace(0, 200, 90)[None, :, None], (70, 1, 3)).astype(int)
    files = {
        "Train/Fake/noise.png": png(noise), "Train/Real/flat.png": png(np.full((64, 64, 3), 77)),
        "Train/Real/dark.png": png(np.full((64, 64, 3), 3)), "Validation/Real/bright.png": png(np.full((64, 64, 3), 250)),
        "Test/Fake/small.png": png(noise[:32, :32]), "Test/Real/wide.png": png(rng.integers(0, 256, (100, 300, 3))),
        "Test/Fake/noise_copy.png": png(noise), "Train/Fake/slope.png": png(slope),
        "Train/Fake/slope_lighter.png": png(slope + 20), "Train/Fake/slope_mirrored.png": png(slope[:, ::-1]),
        "Test/Real/broken.png": png(noise)[:120], "Test/Real/text.PNG": b"this is no image", "Test/Real/note.txt": b"not listed",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, folder):
    return im.scan_images(spark, folder).join(im.content_hashes(spark, folder), "path").withColumnRenamed("stem", "item_id")


def test_scan_items(spark, folder):
    rows = im.scan_items(spark, folder).collect()
    assert len(rows) == 12
    known = {r["stem"]: (r["split"], r["class"]) for r in rows}
    assert known["noise_copy.png"] == ("Test", "Fake") and known["bright.png"] == ("Validation", "Real")


def test_scan_images_keeps_broken_files(scanned):
    rows = {r["item_id"]: r for r in scanned.collect()}
    assert {n for n, r in rows.items() if r["is_corrupt"]} == {"broken.png", "text.PNG"}
    assert rows["broken.png"]["error"] and rows["broken.png"]["data"] is None and rows["broken.png"]["content_md5"]
    assert rows["noise.png"]["content_md5"] == rows["noise_copy.png"]["content_md5"]
    assert (rows["wide.png"]["height"], rows["wide.png"]["width"]) == (100, 300)


def slow_laplacian_var(g):
    h, w = g.shape
    at = lambda y, x: float(g[y, x]) if 0 <= y < h and 0 <= x < w else 0.0
    vals = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    mean = sum(vals) / len(vals)
    return sum((v - mean) ** 2 for v in vals) / len(vals)


def slow_resize(g, th, tw):
    h, w = g.shape
    out = np.zeros((th, tw))
    for i in range(th):
        for j in range(tw):
            y0, y1, x0, x1 = i * h / th, (i + 1) * h / th, j * w / tw, (j + 1) * w / tw
            total = 0.0
            for y in range(int(y0), min(h, math.ceil(y1))):
                for x in range(int(x0), min(w, math.ceil(x1))):
                    total += max(0, min(y1, y + 1) - max(y0, y)) * max(0, min(x1, x + 1) - max(x0, x)) * g[y, x]
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


def slow_dct_energy(g):
    total, blocks = 0.0, 0
    for y in range(0, g.shape[0] - 8, 8):
        for x in range(0, g.shape[1] - 8, 8):
            blocks += 1
            for u in range(1, 8):
                for v in range(1, 8):
                    total += abs(sum(
                        g[y + a, x + b] * math.cos(math.pi * (2 * a + 1) * u / 16) * math.cos(math.pi * (2 * b + 1) * v / 16)
                        for a in range(8) for b in range(8)) / 4)
    return total / max(blocks, 1)


def slow_forensics(bgr):
    side = 256
    rgb = np.stack([slow_resize(bgr[:, :, i].astype(float), side, side).round(6) for i in (2, 1, 0)], axis=2)
    mean = slow_resize(bgr.mean(axis=2), side, side).round(6)
    low = mid = high = 0.0
    for y in range(0, side - 1, 2):
        for x in range(0, side - 1, 2):
            diff = abs(mean[y, x] - mean[y, x + 1]) + abs(mean[y, x] - mean[y + 1, x])
            if x < side / 3 or y < side / 3:
                low += diff
            elif x > side * 2 / 3 or y > side * 2 / 3:
                high += diff
            else:
                mid += diff
    regions = [mean[y:y + 8, x:x + 8].var() for y in range(0, side - 8, 8) for x in range(0, side - 8, 8)]
    bins = [0] * 64
    for v in mean.ravel():
        bins[int(v // 4)] += 1
    edges = jumps = count = 0
    for y in range(2, side - 2, 4):
        for x in range(2, side - 2, 4):
            count += 1
            m = mean[y - 1:y + 2, x - 1:x + 2]
            gx = m[0, 2] - m[0, 0] + 2 * (m[1, 2] - m[1, 0]) + m[2, 2] - m[2, 0]
            gy = m[2, 0] - m[0, 0] + 2 * (m[2, 1] - m[0, 1]) + m[2, 2] - m[0, 2]
            edges += 50 < round(math.hypot(gx, gy), 4) < 100
    for y in range(8, side - 8, 8):
        for x in range(8, side - 8, 8):
            jumps += abs(rgb[y, x, 0] - rgb[y, x + 1, 0]) > 20
    sym = [abs(mean[y, x] - mean[y, side - 1 - x]) for y in range(0, side, 4) for x in range(0, side // 2, 4)]
    return {"high_freq_ratio": high / (low + mid + high + 1), "low_var_ratio": sum(v < 100 for v in regions) / len(regions),
            "peak_ratio": max(bins) / side ** 2, "edge_ratio": edges / count, "block_ratio": jumps / len(regions), "symmetry_diff": sum(sym) / len(sym)}


def image_of(row):
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], 3)


def test_basic_features(scanned):
    found = {r["item_id"]: r for r in px.pixel_features(scanned, ["basic", "blur"]).collect()}
    assert found["broken.png"]["brightness"] is None and found["broken.png"]["dhash"] is None
    assert found["flat.png"]["pixel_std"] == 0 and found["flat.png"]["brightness"] == 77
    assert found["dark.png"]["brightness"] == 3 and found["bright.png"]["brightness"] == 250
    assert found["noise.png"]["dhash"] == found["noise_copy.png"]["dhash"]
    assert found["slope.png"]["dhash"] == found["slope_lighter.png"]["dhash"] == 0
    assert found["slope_mirrored.png"]["dhash"] == -1
    assert found["noise.png"]["blur_score"] > found["slope.png"]["blur_score"]


def test_artifacts_against_loops(scanned):
    rows = {r["item_id"]: r for r in scanned.collect()}
    found = {r["item_id"]: r for r in px.pixel_features(scanned, "artifacts").collect()}
    for name in ("small.png", "slope.png", "noise.png"):
        bgr = image_of(rows[name])
        g = np.array([[(19595 * int(r) + 38470 * int(gr) + 7471 * int(b) + 32768) >> 16 for b, gr, r in line] for line in bgr], dtype=float)
        f = found[name]
        assert math.isclose(f["laplacian_var"], slow_laplacian_var(g), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(f["contrast"], g.std(), rel_tol=1e-9)
        if name == "small.png":
            assert math.isclose(f["avg_dct_energy"], slow_dct_energy(g), rel_tol=1e-9)
        h, w = g.shape
        crop = g[h // 2 - h // 6:h // 2 + h // 6, w // 2 - w // 6:w // 2 + w // 6]
        assert math.isclose(f["skin_smoothness_std"], crop.std(), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(f["file_size_kb"], rows[name]["file_size"] / 1024)


def test_resize_and_forensics_against_loops():
    rng = np.random.default_rng(8)
    bgr = rng.integers(0, 256, (37, 53, 3)).astype(np.uint8)
    g = px.grey(bgr)
    assert np.allclose(px.area_resize(g, 8, 9), slow_resize(g, 8, 9))
    got = px.forensic_signals(bgr, 0)
    for key, value in slow_forensics(bgr).items():
        assert math.isclose(got[key], value, rel_tol=1e-6, abs_tol=1e-6), key


def test_families_share_a_pass(scanned):
    both = {r["item_id"]: r.asDict() for r in px.pixel_features(scanned, ["basic", "blur", "artifacts", "residual"]).collect()}
    for family in ("basic", "blur", "artifacts", "residual"):
        for r in px.pixel_features(scanned, family).collect():
            assert all(both[r["item_id"]][c] == v for c, v in r.asDict().items())


def test_vectors_and_augmentation(scanned):
    good = scanned.where("not is_corrupt")
    row = px.feature_vectors(good.where("item_id = 'flat.png'"), 4).first()
    want = [(77 / 255 - m) / s for m, s in zip((0.485, 0.456, 0.406), (0.229, 0.224, 0.225)) for _ in range(16)]
    assert np.allclose(row["vector"], want, atol=1e-6)
    once = {r["item_id"]: bytes(r["data"]) for r in px.augment(good, 1).collect()}
    again = {r["item_id"]: bytes(r["data"]) for r in px.augment(good.repartition(5), 1).collect()}
    other = {r["item_id"]: bytes(r["data"]) for r in px.augment(good, 2).collect()}
    assert once == again and once != other and len(once) == 10
    flipped = px.augment(good.where("item_id = 'slope.png'"), 1, ["flip"]).first()
    source = image_of(good.where("item_id = 'slope.png'").first())
    assert np.array_equal(image_of(flipped), source[:, ::-1])


def test_attention_regions_on_seven_by_seven(spark):
    rng = np.random.default_rng(3)
    cam = rng.random((7, 7))
    row = inv.attention_regions(spark.createDataFrame([(1, cam.tolist())], "id int, cam array<array<double>>")).first()
    energy = cam.sum() + 1e-8
    corners = cam[0, 0] + cam[0, 6] + cam[6, 0] + cam[6, 6]
    assert row["center_pct"] == round(cam[1:5, 1:5].sum() / energy * 100, 1)
    assert row["corner_pct"] == round(corners / energy * 100, 1)
    assert row["max_activation"] == round(cam.max(), 4) and row["mean_activation"] == round(cam.mean(), 4)


def test_reports_round_trip(spark, tmp_path):
    doc = {"exact_duplicates": {"h1": ["a", "b"], "h2": ["c", "d", "e"]},
           "near_duplicates": [{"path1": "a", "path2": "c", "distance": 3}], "corrupt_files": [], "issues": []}
    (tmp_path / "audit.json").write_text(json.dumps(doc, indent=2))
    report = rp.read_report(spark, str(tmp_path / "audit.json"), rp.AUDIT_REPORT)
    assert {tuple(r) for r in rp.report_groups(report).collect()} == {("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "d"), ("h2", "e")}
    assert rp.report_list(report, "near_duplicates").first()["distance"] == 3
    (tmp_path / "flips.json").write_text(json.dumps({"note": "x", "flips": [{"path": "p", "stored": 1, "corrected": 0}]}))
    flips = rp.report_list(rp.read_report(spark, str(tmp_path / "flips.json"), rp.FLIP_MANIFEST), "flips")
    assert tuple(flips.first()) == ("p", 1, 0)
    (tmp_path / "hn.json").write_text(json.dumps([{"path": "p", "prob": 0.9}, {"path": "q", "prob": 0.8}], indent=1))
    assert rp.read_report(spark, str(tmp_path / "hn.json"), rp.SCORE_MANIFEST).count() == 2
    rp.write_report({"t": spark.range(20)}, str(tmp_path / "out"), "json", {"t": (["id"], 5)})
    assert spark.read.json(str(tmp_path / "out" / "t")).count() == 5
    for i in range(3):
        rp.append_log(spark.createDataFrame([(i,)], "iteration int"), str(tmp_path / "log"))
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "log")).orderBy("iteration").collect()] == [0, 1, 2]


def test_upload_decoding(spark):
    df = spark.createDataFrame([("data:image/png;base64,aGVsbG8=",), ("aGVsbG8=",)], "u string")
    assert [bytes(r["content"]) for r in im.decode_upload(df, "u").collect()] == [b"hello", b"hello"]


def test_path_meta_takes_the_last_match(spark):
    df = spark.createDataFrame([("/Train/x/Real/Test/Fake/a.jpg",), ("/none/b.jpg",)], "path string")
    rows = [tuple(r["m"]) + (r["n"],) for r in df.select(sc.path_meta(F.col("path")).alias("m"), sc.file_name(F.col("path")).alias("n")).collect()]
    assert rows == [("Test", "Fake", "a.jpg"), (None, None, "b.jpg")]


def test_folder_audit(spark, folder):
    """A folder of files to all tables of an audit, broken files included."""
    tables = audit_folder(spark, folder)
    summary = tables["summary"].first()
    assert (summary["total_images"], summary["valid_images"], summary["corrupt_images"]) == (12, 10, 2)
    assert summary["exact_duplicate_groups"] == 1 and summary["cross_split_leakage"]
    assert {r["item_id"].rsplit("/", 1)[1] for r in tables["errors"].collect()} == {"broken.png", "text.PNG"}
    flags = {r["flag"]: (r["n_flagged"], r["percent"]) for r in tables["flags"].collect()}
    assert flags["is_dark"] == (1, 10.0) and flags["is_corrupt"] == (2, round(200 / 12, 6))
    assert tables["issues"].first()["severity"] == "CRITICAL"
    assert {r["metric"]: r["n"] for r in tables["profile"].collect()}["brightness"] == 10
    assert "Exchange" not in px.pixel_features(im.scan_images(spark, folder), "basic", carry=("path",))._jdf.queryExecution().toString()
