"""Row-level rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import scalar as sc
from curatrix.functions.bits import array_dhash, band_keys, hamming
from curatrix.plans.oracle_views import FINGERPRINTS, ITEMS, METRICS, PREDICTIONS, with_views
from curatrix.plans.registry import query
from curatrix.sources import tables as t


@query("path_meta", with_views(ITEMS) + r"""
SELECT item_id,
       list_filter(string_split(path, '/'), lambda x: x IN ('Train', 'Validation', 'Test'))[-1] AS split,
       list_filter(string_split(path, '/'), lambda x: x IN ('Fake', 'Real'))[-1] AS class
FROM pathed""")
def path_meta(spark, d):
    return t.items(spark, d).select("item_id", sc.path_meta(F.col("path")).alias("m")).select("item_id", "m.*")


@query("file_name", with_views(ITEMS) + "SELECT item_id, string_split(path, '/')[-1] AS name FROM pathed")
def file_name(spark, d):
    return t.items(spark, d).select("item_id", sc.file_name(F.col("path")).alias("name"))


@query("upload_accepted", r"""
WITH up AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'fr' THEN 'image/webp' WHEN 'de' THEN 'IMAGE/GIF' ELSE 'video/mp4' END AS mime,
                   n_chars * 4096 AS size FROM documents)
SELECT doc_id, mime IN ('image/jpeg', 'image/png', 'image/webp') AND size <= 10485760 AS photo_ok,
       mime IN ('video/mp4', 'video/quicktime') AND size <= 10485760 AS video_ok,
       CASE WHEN lower(mime) IN ('image/png', 'image/webp', 'image/gif') THEN lower(mime) ELSE 'image/jpeg' END AS normal_mime
FROM up""")
def upload_accepted(spark, d):
    mime = (F.when(F.col("lang") == "en", "image/jpeg").when(F.col("lang") == "fr", "image/webp")
            .when(F.col("lang") == "de", "IMAGE/GIF").otherwise("video/mp4"))
    size = F.col("n_chars") * 4096
    return t.table(spark, d, "documents").select(
        "doc_id", sc.is_accepted(mime, size, "photo").alias("photo_ok"), sc.is_accepted(mime, size, "video").alias("video_ok"),
        sc.normal_mime(mime).alias("normal_mime"))


@query("content_hash", "SELECT page_id, md5(html) AS content_md5 FROM pages")
def content_hash(spark, d):
    return t.table(spark, d, "pages").select("page_id", sc.content_hash(F.col("html")).alias("content_md5"))


@query("decode_upload", r"""
SELECT doc_id, md5(text) AS content_md5, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""")
def decode_upload(spark, d):
    packed = F.base64(F.encode("text", "UTF-8"))
    upload = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), packed)).otherwise(packed)
    content = sc.decode_upload(F.col("upload"))
    return t.table(spark, d, "documents").select("doc_id", upload.alias("upload")).select(
        "doc_id", sc.content_hash(content).alias("content_md5"), F.octet_length(content).cast("bigint").alias("n_bytes"))


@query("array_dhash", r"""
SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i:
         CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(63 - i AS BIGINT) ELSE 0 END)) AS BIGINT) AS dhash,
       CAST(list_sum(list_transform(list_filter(range(1, 64), lambda i: i % 8 <> 0), lambda i:
         CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(55 - (i - 1 - (i - 1) // 8) AS BIGINT) ELSE 0 END)) AS BIGINT) AS grid_dhash
FROM embeddings""")
def array_dhash_query(spark, d):
    return t.vec_dhash_input(spark, d).select(
        "vec_id", array_dhash("embedding", 64).cast("bigint").alias("dhash"), array_dhash("embedding", 64, 8).cast("bigint").alias("grid_dhash"))


@query("hamming_distance", r"""
WITH h AS (SELECT vec_id, CAST(list_sum(list_transform(range(1, 64), lambda i:
         CASE WHEN embedding[i] > embedding[i + 1] THEN CAST(1 AS BIGINT) << CAST(63 - i AS BIGINT) ELSE 0 END)) AS UBIGINT) AS x FROM embeddings)
SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.x, b.x)) AS INTEGER) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1""")
def hamming_distance(spark, d):
    hashed = t.vec_dhash_input(spark, d).select("vec_id", array_dhash("embedding", 64).alias("x"))
    following = hashed.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("id_b"), F.col("x").alias("y"))
    return hashed.join(following, "vec_id").select(
        F.col("vec_id").alias("id_a"), "id_b", hamming(F.col("x"), F.col("y")).cast("int").alias("distance"))


@query("band_keys", with_views(ITEMS, FINGERPRINTS, r"""
combos AS (SELECT row_number() OVER (ORDER BY i, j, k) - 1 AS combo, i, j, k
  FROM range(8) a(i), range(8) b(j), range(8) c(k) WHERE i < j AND j < k),
keyed AS (SELECT item_id, combo, ((fp >> CAST(8 * i AS UBIGINT)) & 255) * 65536 + ((fp >> CAST(8 * j AS UBIGINT)) & 255) * 256 + ((fp >> CAST(8 * k AS UBIGINT)) & 255) AS v
  FROM fps, combos),
buckets AS (SELECT combo, v, count(*) AS n FROM keyed GROUP BY combo, v)""") + r"""
SELECT CAST(combo AS INTEGER) AS combo, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_items, max(n) AS largest FROM buckets GROUP BY combo""")
def band_keys_query(spark, d):
    keyed = t.fingerprints(spark, d).select(F.explode(band_keys("fp")).alias("k")).select("k.*")
    return keyed.groupBy("combo", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("combo").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_items"), F.max("n").alias("largest"))


@query("geometry_flags", with_views(ITEMS, METRICS) + r"""
SELECT item_id, width, height, round(aspect_ratio, 6) AS aspect_ratio, is_low_res, is_non_square FROM metrics""")
def geometry_flags(spark, d):
    return t.item_metrics(spark, d).select(
        "item_id", "width", "height", F.round("aspect_ratio", 6).alias("aspect_ratio"), "is_low_res", "is_non_square")


@query("quality_flags", with_views(ITEMS, METRICS) + r"""
SELECT item_id, brightness, blur_score, pixel_std, is_blurry, is_blank, is_dark, is_bright FROM metrics""")
def quality_flags(spark, d):
    return t.item_metrics(spark, d).select(
        "item_id", "brightness", "blur_score", "pixel_std", "is_blurry", "is_blank", "is_dark", "is_bright")


@query("sigmoid_scores", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 8) AS p, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit / 1.5::DOUBLE)), 8) AS p_scaled FROM predictions""")
def sigmoid_scores(spark, d):
    return t.predictions(spark, d).select(
        "item_id", F.round(sc.sigmoid(F.col("logit")), 8).alias("p"), F.round(sc.sigmoid(F.col("logit"), 1.5), 8).alias("p_scaled"))


@query("calibrated_verdict", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, p_ens >= 0.52::DOUBLE AS is_fake,
       round((CASE WHEN p_ens >= 0.52::DOUBLE THEN p_ens ELSE 1.0::DOUBLE - p_ens END) * 100, 1) AS confidence,
       round(p_ens * 100, 1) AS probability_fake, round(p_ens * 100, 1) AS risk_score,
       CASE WHEN p_ens >= 0.52::DOUBLE AND p_ens > 0.8::DOUBLE THEN 'LIKELY DEEPFAKE' WHEN p_ens >= 0.52::DOUBLE AND p_ens > 0.6::DOUBLE THEN 'POSSIBLY DEEPFAKE'
            WHEN p_ens < 0.52::DOUBLE AND 1.0::DOUBLE - p_ens > 0.6::DOUBLE THEN 'LIKELY AUTHENTIC' ELSE 'INCONCLUSIVE' END AS verdict
FROM predictions""")
def calibrated_verdict(spark, d):
    return t.predictions(spark, d).select("item_id", sc.calibrated_verdict(F.col("p_ens"), 0.52).alias("v")).select("item_id", "v.*")


@query("risk_verdict", r"""
WITH s AS (SELECT event_id, least(value, 100.0::DOUBLE) AS score FROM events)
SELECT event_id, score >= 50 AS is_fake, least(greatest(score + 15, 50), 95)::DOUBLE AS confidence, CAST(round(score) AS BIGINT) AS risk_score,
       CASE WHEN score >= 85 THEN 'LIKELY DEEPFAKE' WHEN score >= 55 THEN 'POSSIBLY DEEPFAKE' WHEN score >= 40 THEN 'INCONCLUSIVE' ELSE 'LIKELY AUTHENTIC' END AS verdict
FROM s""")
def risk_verdict(spark, d):
    score = F.least(F.col("value"), F.lit(100.0))
    return t.table(spark, d, "events").select("event_id", sc.risk_verdict(score).alias("v")).select("event_id", "v.*")


@query("heuristic_score", with_views(ITEMS, METRICS, r"""
sig AS (SELECT item_id, pixel_std / 8 AS hf, 1.0::DOUBLE / (1.0::DOUBLE + blur_score / 50) AS lv, brightness / 1200 AS peak,
               blur_score / 400 AS edge, width / 1000.0::DOUBLE AS block, height / 4.0::DOUBLE AS sym FROM metrics WHERE NOT is_corrupt)""") + r"""
SELECT item_id,
       CAST(least(100, (CASE WHEN hf > 0.45 THEN 25 WHEN hf > 0.40 THEN 15 ELSE 0 END) + (CASE WHEN lv > 0.5 THEN 30 WHEN lv > 0.35 THEN 20 ELSE 0 END)
         + (CASE WHEN peak > 0.15 THEN 15 ELSE 0 END) + (CASE WHEN edge > 0.25 THEN 20 ELSE 0 END)
         + (CASE WHEN block < 0.1 THEN 15 ELSE 0 END) + (CASE WHEN sym < 3 THEN 10 ELSE 0 END)) AS INTEGER) AS score,
       concat_ws('; ', CASE WHEN hf > 0.45 THEN 'high-frequency pattern' WHEN hf > 0.40 THEN 'elevated high-frequency' END,
         CASE WHEN lv > 0.5 THEN 'excessive uniformity' WHEN lv > 0.35 THEN 'local uniformity' END,
         CASE WHEN peak > 0.15 THEN 'color distribution peak' END, CASE WHEN edge > 0.25 THEN 'irregular edges' END,
         CASE WHEN block < 0.1 THEN 'compression artifacts' END, CASE WHEN sym < 3 THEN 'facial symmetry' END) AS signals
FROM sig""")
def heuristic_score(spark, d):
    c = F.col
    found = sc.heuristic_score({
        "high_freq_ratio": c("pixel_std") / 8, "low_var_ratio": 1.0 / (1.0 + c("blur_score") / 50), "peak_ratio": c("brightness") / 1200,
        "edge_ratio": c("blur_score") / 400, "block_ratio": c("width") / 1000.0, "symmetry_diff": c("height") / 4.0})
    return t.item_metrics(spark, d).where(~c("is_corrupt")).select("item_id", found.alias("h")).select(
        "item_id", "h.score", F.array_join("h.signals", "; ").alias("signals"))


@query("score_band", r"""
SELECT event_id, CASE WHEN value > 70 THEN 'danger' WHEN value >= 40 THEN 'warning' ELSE 'safe' END AS band FROM events""")
def score_band(spark, d):
    return t.table(spark, d, "events").select("event_id", sc.score_band(F.col("value")).alias("band"))


@query("metadata_flags", r"""
WITH meta AS (
  SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'Adobe Photoshop 25' WHEN 1 THEN 'Stable Diffusion XL' WHEN 2 THEN 'Canva' WHEN 3 THEN 'mail client'
           WHEN 4 THEN 'Lightroom' WHEN 5 THEN 'Art AI 2' END AS software,
         CASE WHEN event_type <> 'error' THEN 'maker' END AS make, CASE WHEN value >= 10 THEN value END AS latitude,
         CASE WHEN event_type <> 'view' THEN ts END AS captured_at, event_id % 120 AS age
  FROM events)
SELECT event_id, concat_ws('; ',
  CASE WHEN software IS NULL THEN NULL
       WHEN regexp_matches(lower(software), '(^|[^a-z0-9])(midjourney|dall-e|dalle|stable diffusion|firefly|generative fill|ai|topaz|runway|canva)([^a-z0-9]|$)') THEN 'ai software: ' || software
       WHEN regexp_matches(lower(software), 'photoshop|lightroom') THEN 'edited with image software' ELSE 'software tag: ' || software END,
  CASE WHEN make IS NULL THEN 'no camera make/model' END, CASE WHEN latitude IS NULL THEN 'gps data absent' END,
  CASE WHEN captured_at IS NULL THEN 'no original capture timestamp' WHEN age < 60 THEN 'created very recently' END) AS flags
FROM meta""")
def metadata_flags(spark, d):
    c = F.col
    kind = c("user_id") % 7
    software = F.when(kind == 0, "Adobe Photoshop 25")
    for i, name in enumerate(("Stable Diffusion XL", "Canva", "mail client", "Lightroom", "Art AI 2"), 1):
        software = software.when(kind == i, name)
    meta = F.struct(
        software.alias("software"), F.when(c("event_type") != "error", "maker").alias("make"), F.lit("model").alias("model"),
        F.when(c("value") >= 10, c("value")).alias("latitude"), c("value").alias("longitude"),
        F.when(c("event_type") != "view", c("ts")).alias("captured_at"))
    now = F.timestamp_seconds(F.unix_timestamp("ts") + c("event_id") % 120)
    return t.table(spark, d, "events").select(
        "event_id", F.array_join(sc.metadata_flags(meta, now), "; ").alias("flags"))


@query("parse_answer", r"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN NULL ELSE role END AS verdict, CASE WHEN role = 'user' THEN NULL ELSE CAST(turn AS INTEGER) END AS confidence,
       CASE WHEN role = 'user' THEN NULL ELSE CAST(length(text) AS INTEGER) END AS risk_score,
       CASE WHEN role = 'user' THEN NULL ELSE CAST(length('{"verdict":"' || role || '","confidence":' || turn || ',"risk_score":' || length(text) || '}') AS INTEGER) END AS n_json
FROM conversations""")
def parse_answer(spark, d):
    c = F.col
    body = F.concat(F.lit('{"verdict":"'), c("role"), F.lit('","confidence":'), c("turn").cast("string"),
                    F.lit(',"risk_score":'), F.length("text").cast("string"), F.lit("}"))
    answer = F.when(c("role") == "user", c("text")).otherwise(
        F.concat(F.lit("<think>{"), c("text"), F.lit("}</think>\n```json\n"), body, F.lit("\n```\nthat is all")))
    return t.table(spark, d, "conversations").select("conv_id", "turn", answer.alias("answer")).select(
        "conv_id", "turn", sc.parse_answer(c("answer")).alias("a"), F.length(sc.answer_json(c("answer"))).alias("n_json")).select(
        "conv_id", "turn", "a.verdict", "a.confidence", "a.risk_score", "n_json")


@query("smooth_target", with_views(ITEMS, PREDICTIONS) + r"""
SELECT item_id, CASE WHEN label = 1 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END AS asymmetric, round(label * 0.9::DOUBLE + 0.05::DOUBLE, 6) AS symmetric FROM predictions""")
def smooth_target(spark, d):
    return t.predictions(spark, d).select(
        "item_id", sc.smooth_target(F.col("label")).alias("asymmetric"), F.round(sc.smooth_target_symmetric(F.col("label")), 6).alias("symmetric"))


@query("impute_default", with_views(ITEMS, METRICS) + r"""
SELECT item_id, coalesce(brightness, 128.0::DOUBLE) AS brightness, brightness IS NULL AS was_imputed FROM metrics""")
def impute_default(spark, d):
    return t.item_metrics(spark, d).select("item_id", sc.impute_default(F.col("brightness"), 128.0).alias("b")).select(
        "item_id", F.col("b.value").alias("brightness"), "b.was_imputed")
