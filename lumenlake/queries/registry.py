"""Name -> (Spark query, DuckDB SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions import detections as D
from lumenlake.functions import tokens as T
from lumenlake.functions import values as V
from lumenlake.graph import components, extended
from lumenlake.operators import bursts, catalogue, decide, events, mutate, pairs, reconcile, vectors
from lumenlake.sources.fixtures import duckdb_with, view

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, views: str, sql: str | None):
    """Register a function of the named views; views: their names, by spaces; sql: what follows the WITH clause."""

    def wrap(f):
        used = views.split()
        _ALL[name] = (lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in used]), None if sql is None else duckdb_with(*used) + sql)
        return f

    return wrap


# ---- scalar functions

_SAFE = "coalesce(nullif(regexp_replace(trim({0}), '[^\\p{{L}}\\p{{N}}\\-_.]', '_', 'g'), ''), '_unknown')"


@_add("src_2_file_kind", "images_fx", " SELECT id, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'jpg' THEN 'jpeg' WHEN 'nef' THEN 'raw' WHEN 'heic' THEN 'heic' WHEN 'png' THEN 'other' ELSE 'unknown' END AS kind FROM images_fx")
def _(i):
    return i.select("id", T.file_kind("path").alias("kind"))


@_add("fn_1_hamming", "images_fx", " SELECT a.id, CAST(bit_count(xor(('0x'||substr(a.phash,1,8))::bigint, ('0x'||substr(b.phash,1,8))::bigint)) + bit_count(xor(('0x'||substr(a.phash,9,8))::bigint, ('0x'||substr(b.phash,9,8))::bigint)) AS INTEGER) AS bits FROM images_fx a JOIN images_fx b ON b.id = a.id + 1")
def _(i):
    n = i.select((F.col("id") - 1).alias("id"), F.col("phash").alias("other"))
    return i.select("id", "phash").join(n, "id").select("id", V.hamming("phash", "other").alias("bits"))


@_add("fn_2_4_safe_tokens", "images_fx", f" SELECT id, {_SAFE.format('camera_make')} AS make, {_SAFE.format('camera_model')} AS model, {_SAFE.format('lens_model')} AS lens, {_SAFE.format(chr(34) + 'both' + chr(34))} AS make_model FROM (SELECT *, concat_ws(' ', nullif(trim(camera_make), ''), nullif(trim(camera_model), '')) AS \"both\" FROM images_fx)")
def _(i):
    return i.select("id", T.token("camera:make").alias("make"), T.token("camera:model").alias("model"), T.token("lens:model").alias("lens"), T.token("camera:make_model").alias("make_model"))


@_add("fn_3_date_tokens", "images_fx", " SELECT id, coalesce(strftime(make_timestamp(capture_s * 1000000), '%Y'), '_undated') AS y, coalesce(strftime(make_timestamp(capture_s * 1000000), '%Y-%m-%d'), '_undated') AS ymd, coalesce(strftime(make_timestamp(capture_s * 1000000), '%Y/%m'), '_undated') AS ym FROM images_fx")
def _(i):
    return i.select("id", T.token("date:YYYY").alias("y"), T.token("date:YYYY-MM-DD").alias("ymd"), T.token("date:YYYY/MM").alias("ym"))


@_add("fn_5_8_buckets", "images_fx", " SELECT id, CASE WHEN focal_length_mm IS NULL THEN '_unknown' WHEN focal_length_mm < 16 THEN 'ultrawide' WHEN focal_length_mm < 35 THEN 'wide' WHEN focal_length_mm < 70 THEN 'standard' WHEN focal_length_mm < 135 THEN 'short-tele' WHEN focal_length_mm < 300 THEN 'tele' ELSE 'super-tele' END AS focal, CASE WHEN width IS NULL OR height IS NULL THEN '_unknown' WHEN abs(width - height) <= 0.02e0 * greatest(width, height) THEN 'square' WHEN width > height THEN 'landscape' ELSE 'portrait' END AS orient, CASE WHEN coalesce(iso, 0) = 0 THEN '_unknown' WHEN iso <= 200 THEN 'iso-low' WHEN iso <= 1600 THEN 'iso-mid' WHEN iso <= 6400 THEN 'iso-high' ELSE 'iso-extreme' END AS iso_b, CASE WHEN coalesce(f_number, 0) = 0 THEN 'mid' WHEN f_number < 2.8e0 THEN 'wide' WHEN f_number <= 5.6e0 THEN 'mid' ELSE 'narrow' END AS aperture FROM images_fx")
def _(i):
    return i.select("id", T.focal_bucket("focal_length_mm").alias("focal"), T.orientation("width", "height").alias("orient"), T.iso_bucket("iso").alias("iso_b"), T.aperture_bucket("f_number").alias("aperture"))


@_add("fn_10_palette_tokens", "metrics_fx", f" SELECT image_id, {_SAFE.format('scene')} AS scene, {_SAFE.format('content_type')} AS content_type, {_SAFE.format('temperature')} AS temperature, {_SAFE.format('saturation')} AS saturation FROM metrics_fx")
def _(m):
    return m.select("image_id", *[T.safe(c).alias(c) for c in ("scene", "content_type", "temperature", "saturation")])


@_add("fn_11_hemisphere", "images_fx", " SELECT id, CASE WHEN gps_lat IS NULL OR gps_lon IS NULL THEN '_unknown' ELSE concat('hemisphere-', CASE WHEN gps_lat >= 0 THEN 'N' ELSE 'S' END, CASE WHEN gps_lon >= 0 THEN 'E' ELSE 'W' END) END AS place FROM images_fx")
def _(i):
    return i.select("id", T.token("gps:country").alias("place"))


@_add("fn_12_exposure_text", "images_fx", " SELECT id, CASE WHEN exposure_time >= 1 THEN concat(CAST(exposure_time AS BIGINT), 's') WHEN exposure_time > 0 THEN concat('1/', CAST(round_even(1 / exposure_time, 0) AS BIGINT)) END AS exposure FROM images_fx")
def _(i):
    return i.select("id", T.exposure_text("exposure_time").alias("exposure"))


@_add("fn_13_hsl", "metrics_fx", ", n AS (SELECT image_id, dom_r / 255e0 AS r, dom_g / 255e0 AS g, dom_b / 255e0 AS b FROM metrics_fx), x AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM n), h AS (SELECT image_id, CASE WHEN hi = lo THEN 0e0 WHEN hi = r THEN 60 * ((g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) WHEN hi = g THEN 60 * ((b - r) / (hi - lo) + 2) ELSE 60 * ((r - g) / (hi - lo) + 4) END AS h, CASE WHEN hi = lo THEN 0e0 WHEN (hi + lo) / 2 > 0.5e0 THEN (hi - lo) / (2 - hi - lo) ELSE (hi - lo) / (hi + lo) END AS s, (hi + lo) / 2 AS l FROM x) SELECT image_id, round(h, 6) AS h, round(s, 6) AS s, round(l, 6) AS l, round(CASE WHEN abs(h - 30) > 180 THEN 360 - abs(h - 30) ELSE abs(h - 30) END, 6) AS to_orange FROM h")
def _(m):
    c = m.select("image_id", V.hsl("dom_r", "dom_g", "dom_b").alias("c"))
    return c.select("image_id", *[F.round(f"c.{x}", 6).alias(x) for x in "hsl"], F.round(V.hue_distance("c.h", F.lit(30.0)), 6).alias("to_orange"))


@_add("pix_5_sharpness_score", "metrics_fx", " SELECT image_id, round(0.5e0 * laplacian_var / (laplacian_var + 150) + 0.5e0 * tenengrad / (tenengrad + 600), 9) AS score FROM metrics_fx")
def _(m):
    return m.select("image_id", F.round(V.sharpness_score("laplacian_var", "tenengrad", "decoded_long"), 9).alias("score"))


# ---- decisions

_FLAGS = "f AS (SELECT *, mean_luma < 50 AND clipped_shadow > 0.2e0 AS under, mean_luma > 210 OR clipped_highlight > 0.15e0 AS over, coalesce(subject_sharp_score, sharp_score) AS sharp FROM metrics_fx)"
_TERMS = """, """ + _FLAGS + """, terms AS (SELECT *, CASE WHEN over OR under THEN 0.2e0 ELSE 0.6e0 * (1 - abs(mean_luma - 128) / 128) + 0.4e0 * least(1e0, dynamic_range / 200) END AS e,
CASE WHEN faces = 0 THEN NULL WHEN any_closed AND (closed_count IS NULL OR closed_count - occluded_count > 0) THEN 0e0 WHEN min_ear IS NULL THEN NULL ELSE greatest(0e0, least(1e0, (min_ear - 0.2e0) / (0.35e0 - 0.2e0))) END AS y,
CASE WHEN horizon_tilt_deg IS NULL AND thirds_offset IS NULL THEN NULL WHEN thirds_offset IS NULL THEN greatest(0e0, 1 - abs(horizon_tilt_deg) / 10) WHEN horizon_tilt_deg IS NULL THEN greatest(0e0, 1 - thirds_offset) ELSE (greatest(0e0, 1 - abs(horizon_tilt_deg) / 10) + greatest(0e0, 1 - thirds_offset)) / 2 END AS c,
CASE WHEN aesthetic_source = 'topiq' THEN greatest(0e0, least(1e0, (aesthetic_score - 0.35e0) / 0.4e0)) ELSE aesthetic_score END AS a FROM f),
scored AS (SELECT *, (0.5e0 * sharp + 0.18e0 * e + coalesce(0.14e0 * y, 0) + coalesce(0.08e0 * c, 0) + coalesce(0.1e0 * a, 0)) / (0.5e0 + 0.18e0 + CASE WHEN y IS NULL THEN 0 ELSE 0.14e0 END + CASE WHEN c IS NULL THEN 0 ELSE 0.08e0 END + CASE WHEN a IS NULL THEN 0 ELSE 0.1e0 END) AS score FROM terms)"""
_DECIDED = _TERMS + """, soft AS (SELECT *, faces > 0 AND subject_sharp_score IS NOT NULL AND laplacian_var < 50 * greatest(0.4e0, least(1.5e0, greatest(face_w, face_h) / 2000e0 / 0.35e0)) AS softface, greatest(0, closed_count - occluded_count) AS shut FROM scored),
rules AS (SELECT *, sharp < 0.3e0 OR (softface AND sharp < 0.55e0) AS blurred, any_closed AND (closed_count IS NULL OR (shut > 0 AND (faces <= 1 OR shut >= 0.5e0 * faces))) AS eyes FROM soft),
ruled AS (SELECT *, CASE WHEN blurred OR focus_on_background OR eyes THEN 'reject' WHEN sharp < 0.55e0 OR over OR under THEN 'review' ELSE 'keeper' END AS verdict FROM rules),
binned AS (SELECT *, CASE WHEN score >= 0.8e0 THEN 5 WHEN score >= 0.65e0 THEN 4 WHEN score >= 0.5e0 THEN 3 WHEN score >= 0.35e0 THEN 2 ELSE 1 END AS b FROM ruled),
verdicts_fx AS (SELECT image_id, verdict, CASE verdict WHEN 'reject' THEN 0 WHEN 'keeper' THEN greatest(b, 3) ELSE greatest(2, least(b, 4)) END AS stars, CASE verdict WHEN 'reject' THEN 'red' WHEN 'keeper' THEN 'green' ELSE 'yellow' END AS label,
list_filter([CASE WHEN blurred THEN CASE WHEN fft_anisotropy > 0.45e0 THEN concat('motion blur (~', CAST(blur_angle_deg AS INTEGER), '°)') ELSE 'out of focus' END WHEN focus_on_background THEN 'subject out of focus (background sharp)' WHEN sharp < 0.55e0 THEN 'slightly soft' END,
CASE WHEN eyes THEN CASE WHEN faces <= 1 THEN 'eyes closed' ELSE concat('eyes closed (', CASE WHEN closed_count IS NULL THEN 'None' ELSE CAST(shut AS VARCHAR) END, '/', faces, ')') END END, CASE WHEN over THEN 'overexposed / clipped highlights' END, CASE WHEN under THEN 'underexposed' END], lambda x: x IS NOT NULL) AS reasons,
list_filter([CASE WHEN any_closed AND closed_count IS NOT NULL AND shut > 0 AND NOT eyes THEN concat(shut, ' of ', faces, ' subjects blinking') END, CASE WHEN abs(horizon_tilt_deg) > 3 THEN concat('horizon tilt ', printf('%+.1f', horizon_tilt_deg), '°') END, CASE WHEN cast_hue IS NOT NULL AND cast_strength > 0.25e0 THEN concat(cast_hue, ' colour cast') END], lambda x: x IS NOT NULL) AS warnings,
score, image_id % 29 = 0 AS user_override FROM binned)"""


def _verdicts(m: DataFrame) -> DataFrame:
    return decide.decide(m).withColumn("user_override", F.col("image_id") % 29 == 0)


@_add("dec_2_quality_score", "metrics_fx", _TERMS + " SELECT image_id, round(e, 9) AS exposure, round(y, 9) AS eyes, round(c, 9) AS composition, round(a, 9) AS aesthetic, round(score, 9) AS score FROM scored")
def _(m):
    r = lambda c, n: F.round(c, 9).alias(n)
    return decide.exposure_flags(m).select("image_id", r(decide.exposure_score(), "exposure"), r(decide.eyes_score(), "eyes"), r(decide.composition_score(), "composition"), r(decide.aesthetic_term(), "aesthetic"), r(decide.quality_score(), "score"))


@_add("dec_7_decide", "metrics_fx", _DECIDED + " SELECT image_id, verdict, stars, label, reasons, warnings, round(score, 9) AS score FROM verdicts_fx")
def _(m):
    return decide.decide(m).withColumn("score", F.round("score", 9))


_BURST_SCORE = "0.45e0 * sharp + 0.2e0 * CASE WHEN faces = 0 THEN 1e0 WHEN any_closed THEN 0e0 ELSE 1 - coalesce(max_blink, 0e0) END + 0.1e0 * CASE WHEN faces = 0 THEN 0e0 ELSE coalesce(max_smile, 0e0) END + 0.12e0 * CASE WHEN over OR under THEN 0 ELSE 1 END + 0.1e0 * (1 - least(1e0, clipped_highlight + clipped_shadow)) + 0.13e0 * CASE WHEN coalesce(aesthetic_score, 0) = 0 THEN 0.5e0 ELSE aesthetic_score END"


@_add("dec_9_burst_score", "metrics_fx", f", {_FLAGS} SELECT image_id, round({_BURST_SCORE}, 6) AS score FROM f")
def _(m):
    return decide.exposure_flags(m).select("image_id", F.round(decide.burst_score(), 6).alias("score"))


@_add("dec_10_evaluate", "metrics_fx", _DECIDED + " SELECT m.content_type, count(*) AS n, count(*) FILTER (verdict = 'keeper') AS keepers, count(*) FILTER (stars >= 3) AS starred FROM metrics_fx m JOIN verdicts_fx v ON v.image_id = m.image_id GROUP BY m.content_type")
def _(m):
    return catalogue.evaluate(_verdicts(m).join(m, "image_id"), "content_type", {"keepers": F.col("verdict") == "keeper", "starred": F.col("stars") >= 3})


@_add("mut_3_override", "metrics_fx", _DECIDED + " SELECT image_id, CASE WHEN image_id % 10 = 3 THEN 'keeper' ELSE verdict END AS verdict, CASE WHEN image_id % 10 = 3 THEN 5 ELSE stars END AS stars, label, user_override OR image_id % 10 = 3 AS user_override FROM verdicts_fx")
def _(m):
    v = _verdicts(m).select("image_id", "verdict", "stars", "label", "user_override")
    return mutate.override_verdicts(v, m.where("image_id % 10 = 3").select("image_id", F.lit("keeper").alias("verdict"), F.lit(5).alias("stars")))


# ---- catalogue

_SHEET = _DECIDED + ", j AS (SELECT * FROM images_fx i JOIN verdicts_fx v ON v.image_id = i.id)"


@_add("src_8_contact_sheet", "images_fx metrics_fx", _SHEET + " SELECT id, split_part(path, '/', 5) AS name, repeat('★', stars) AS rating, verdict, array_to_string(reasons, ', ') AS reasons FROM j WHERE verdict = 'keeper'")
def _(i, m):
    return catalogue.contact_sheet(i, _verdicts(m))


@_add("q_1_listing", "images_fx metrics_fx", _SHEET + " SELECT id, verdict, stars FROM j WHERE library_id = 2 AND verdict = 'review' ORDER BY capture_s NULLS LAST, id LIMIT 100 OFFSET 20")
def _(i, m):
    none = m.select("image_id", F.lit(None).cast("long").alias("burst_id"), F.lit(False).alias("is_best")).where("false")
    return catalogue.page(catalogue.list_images(i, _verdicts(m), m.drop("label"), none, verdict="review", library_id=2), 100, 20).select("id", "verdict", "stars")


@_add("q_3_filters", "images_fx metrics_fx", _SHEET + " SELECT id FROM j WHERE stars >= 2 AND (array_to_string(reasons, '|') ILIKE '%focus%' OR array_to_string(reasons, '|') ILIKE '%soft%' OR array_to_string(reasons, '|') ILIKE '%blur%') AND coalesce(iso, 0) <= 1600 AND coalesce(iso, 0) > 200 AND path ILIKE '%img_1%'")
def _(i, m):
    joined = i.join(_verdicts(m).withColumnRenamed("image_id", "id"), "id")
    return catalogue.filter_images(joined, catalogue.Filters(stars_min=2, reason_blur=True, iso="mid", path_contains="IMG_1")).select("id")


@_add("q_5_sort", "images_fx", " SELECT id, coalesce(f_number, 999) AS key FROM images_fx ORDER BY key DESC, id")
def _(i):
    return catalogue.sort_images(i, "aperture", True).select("id", catalogue.sort_key("aperture").alias("key"))


@_add("q_5_sort_all", "images_fx", " SELECT id, coalesce(f_number, 999) AS key FROM images_fx ORDER BY key, id")
def _(i):
    return catalogue.sort_images(i, "aperture").select("id", catalogue.sort_key("aperture").alias("key"))


@_add("q_6_histogram", "metrics_fx", ", g AS (SELECT least(29, CAST(floor(coalesce(aesthetic_score, 0) * 30) AS INTEGER)) AS bin, coalesce(aesthetic_score, 0) >= 0.5e0 AS p FROM metrics_fx) SELECT CAST(r.range AS INTEGER) AS bin, count(g.bin) AS n, count(*) FILTER (p) AS passing FROM range(30) r LEFT JOIN g ON g.bin = r.range GROUP BY ALL")
def _(m):
    return catalogue.histogram(m, "aesthetic_score", 30, 0.5)


@_add("q_7_timeline", "images_fx", ", e AS (SELECT min(capture_s) AS lo, max(capture_s) AS hi FROM images_fx), g AS (SELECT least(59, (capture_s - lo) * 60 // (hi - lo)) AS cell FROM images_fx, e WHERE capture_s IS NOT NULL AND hi > lo) SELECT CAST(r.range AS INTEGER) AS cell, count(g.cell) AS n FROM range(60) r LEFT JOIN g ON g.cell = r.range GROUP BY ALL")
def _(i):
    return catalogue.timeline(i)


@_add("q_8_facets", "images_fx", " SELECT 'camera_model' AS facet, camera_model AS value, count(*) AS n FROM images_fx WHERE camera_model <> '' GROUP BY ALL UNION ALL SELECT 'lens_model', lens_model, count(*) FROM images_fx WHERE lens_model <> '' GROUP BY ALL")
def _(i):
    return catalogue.facets(i, ["camera_model", "lens_model"])


@_add(
    "q_9_library_statistics",
    "images_fx metrics_fx",
    _SHEET
    + """, bad AS (SELECT library_id, count(*) AS n FROM images_fx WHERE id % 37 = 0 GROUP BY library_id),
per AS (SELECT library_id, count(*) AS images, count(*) FILTER (verdict = 'keeper') AS keeper, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'reject') AS reject FROM j GROUP BY library_id)
SELECT CAST(l.range AS BIGINT) AS id, concat('/lib', l.range) AS root_path, CASE WHEN l.range <> 4 THEN make_timestamp(l.range * 5 % 3 * 86400000000) END AS added_at,
  coalesce(images, 0) AS images, coalesce(n, 0) AS errors, coalesce(keeper, 0) AS keeper, coalesce(review, 0) AS review, coalesce(reject, 0) AS reject
FROM range(1, 7) l LEFT JOIN per ON per.library_id = l.range LEFT JOIN bad ON bad.library_id = l.range ORDER BY added_at DESC NULLS LAST, id DESC""",
)
def _(i, m):
    libraries = i.sparkSession.range(1, 7).select("id", F.concat(F.lit("/lib"), F.col("id").cast("string")).alias("root_path"), F.expr("CASE WHEN id <> 4 THEN cast(timestamp_seconds(id * 5 % 3 * 86400) AS timestamp_ntz) END").alias("added_at"))
    return catalogue.library_statistics(libraries, i, _verdicts(m), i.where("id % 37 = 0").select("library_id", "path", F.lit("not decoded").alias("error")))


@_add("q_10_global_statistics", "images_fx metrics_fx", _DECIDED + " SELECT (SELECT count(*) FROM images_fx) AS images, (SELECT count(DISTINCT library_id) FROM images_fx) AS libraries, count(*) FILTER (verdict = 'keeper') AS keeper, count(*) FILTER (verdict = 'review') AS review, count(*) FILTER (verdict = 'reject') AS reject, (SELECT count(DISTINCT image_id // 3) FROM metrics_fx) AS bursts FROM verdicts_fx")
def _(i, m):
    return catalogue.global_statistics(i, _verdicts(m), m.select(F.expr("image_id div 3").alias("burst_id")))


@_add("q_14_cluster_cards", "faces_fx", ", q AS (SELECT *, coalesce(quality, -1) AS q FROM faces_fx WHERE cluster_id IS NOT NULL), b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, image_id ORDER BY q DESC, id) AS r FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY q DESC, id) AS k FROM b WHERE r = 1) SELECT cluster_id, concat('Cluster ', cluster_id) AS label, count(*) AS images, min(id) FILTER (k = 1) AS best_face, list(image_id ORDER BY k) FILTER (k <= 12) AS shown FROM o GROUP BY cluster_id HAVING count(*) >= 2")
def _(f):
    labels = f.where("false").select("cluster_id", F.lit("").alias("label"))
    return catalogue.cluster_cards(f, labels)


# ---- groups, events, vectors

_BITS = "hx AS (SELECT id, library_id, capture_s, ('0x'||substr(phash,1,8))::bigint AS hi, ('0x'||substr(phash,9,8))::bigint AS lo FROM images_fx)"
_PAIRS = "SELECT a.id AS x, b.id AS y FROM hx a JOIN hx b ON a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 10"
_BOTH = ", e AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half)"
_EDGES = f", {_BITS}, half AS ({_PAIRS})" + _BOTH
_NEAR = f", {_BITS}, half AS ({_PAIRS} AND a.library_id IS NOT DISTINCT FROM b.library_id AND (abs(a.capture_s - b.capture_s) <= 3 OR (a.capture_s IS NULL AND b.capture_s IS NULL)))" + _BOTH
_REACH = ", reach AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT node, y FROM reach JOIN e ON seen = x), comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)"


@_add("graph_1_components", "images_fx", _EDGES + _REACH + " SELECT node, c AS component FROM comp")
def _(i):
    return components(pairs.duplicate_links(i)).select("node", "component")


@_add("graph_1_extended", "images_fx", _EDGES + _REACH + " SELECT node, c AS component FROM comp")
def _(i):
    """Components of four fifths of the links, then of the rest on top of them."""
    links = pairs.duplicate_links(i)
    late = F.pmod(F.xxhash64("src", "dst"), F.lit(5)) == 0
    return extended(components(links.where(~late)), links.where(late)).select("node", "component")


@_add("grp_2_bursts", "images_fx metrics_fx", _NEAR + _REACH + f", {_FLAGS}, r AS (SELECT c, node, capture_s, round({_BURST_SCORE}, 9) AS s FROM comp JOIN images_fx ON id = node JOIN f ON image_id = node), k AS (SELECT c, row_number() OVER (ORDER BY t NULLS LAST, n) AS burst_id FROM (SELECT c, min(capture_s) AS t, arg_min(node, (coalesce(capture_s, 9e15), node)) AS n FROM r GROUP BY c)) SELECT burst_id, node AS image_id, row_number() OVER (PARTITION BY r.c ORDER BY s DESC, capture_s NULLS LAST, node) = 1 AS is_best FROM r JOIN k ON k.c = r.c")
def _(i, m):
    return bursts.group_bursts(i, m)


_HEADS = "SELECT min(id) AS id, count(*) AS copies, phash FROM images_fx WHERE phash IS NOT NULL GROUP BY phash"


@_add("grp_2_extended", "images_fx", _NEAR + _REACH + " SELECT node, c AS component FROM comp")
def _(i):
    """The bursts of three quarters of the images, then of the others on top of them."""
    old, new = i.where("id % 4 <> 1"), i.where("id % 4 = 1")
    return bursts.extended_bursts(i, new, components(pairs.burst_pairs(old))).select("node", "component")


@_add("grp_3_hash_classes", "images_fx", f", c AS ({_HEADS}) SELECT i.id, c.id AS head, copies FROM images_fx i JOIN c ON c.phash = i.phash")
def _(i):
    return pairs.hash_classes(i)


@_add("grp_3_hash_pairs", "images_fx", f", hx AS (SELECT id, ('0x'||substr(phash,1,8))::bigint AS hi, ('0x'||substr(phash,9,8))::bigint AS lo FROM ({_HEADS})), p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS bits FROM hx a JOIN hx b ON a.id < b.id) SELECT * FROM p WHERE bits <= 10")
def _(i):
    return pairs.pair_list(i)


@_add("grp_4_duplicate_groups", "images_fx", _EDGES + _REACH + ", w AS (SELECT c FROM comp JOIN images_fx ON id = node GROUP BY c HAVING count(DISTINCT library_id) >= 2) SELECT c AS group_id, node AS image_id, library_id FROM comp SEMI JOIN w USING (c) JOIN images_fx ON id = node")
def _(i):
    return bursts.duplicate_groups(i)


@_add("evt_1_events", "images_fx", ", o AS (SELECT capture_s AS t, CASE WHEN capture_s - lag(capture_s) OVER (ORDER BY capture_s, id) > 21600 THEN 1 ELSE 0 END AS n FROM images_fx WHERE capture_s IS NOT NULL), g AS (SELECT t, sum(n) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS event_id FROM o) SELECT CAST(event_id AS BIGINT) AS event_id, printf('event-%04d', CAST(event_id AS BIGINT)) AS label, min(t) AS start_s, max(t) AS end_s FROM g GROUP BY event_id")
def _(i):
    return events.split_events(i)[0]


@_add("evt_3_by_key", "images_fx", ", o AS (SELECT library_id, id, capture_s, CASE WHEN capture_s - lag(capture_s) OVER w > 21600 THEN 1 ELSE 0 END AS n FROM images_fx WHERE capture_s IS NOT NULL WINDOW w AS (PARTITION BY library_id ORDER BY capture_s, id)) SELECT library_id, id, CAST(sum(n) OVER (PARTITION BY library_id ORDER BY capture_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_no FROM o")
def _(i):
    return events.split_by_key(i, "library_id")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@_add("vec_3_cosine_pairs", "faces_fx", f" SELECT a.id AS src, b.id AS dst FROM faces_fx a JOIN faces_fx b ON a.id < b.id WHERE {_COS} >= 0.38e0")
def _(f):
    return vectors.cosine_pairs(f, 0.38)


@_add("vec_4_clusters", "faces_fx", f", e AS (SELECT a.id AS x, b.id AS y FROM faces_fx a JOIN faces_fx b ON a.id <> b.id WHERE {_COS} >= 0.38e0)" + ", reach AS (SELECT id AS node, id AS seen FROM faces_fx UNION SELECT node, y FROM reach JOIN e ON seen = x), comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node) SELECT node AS id, dense_rank() OVER (ORDER BY c) - 1 AS cluster_id FROM comp")
def _(f):
    return vectors.cluster(f, 0.38)


@_add("vec_4_extended", "faces_fx", f", e AS (SELECT a.id AS x, b.id AS y FROM faces_fx a JOIN faces_fx b ON a.id <> b.id WHERE {_COS} >= 0.38e0)" + ", reach AS (SELECT id AS node, id AS seen FROM faces_fx UNION SELECT node, y FROM reach JOIN e ON seen = x) SELECT node, min(seen) AS component FROM reach GROUP BY node")
def _(f):
    """The clusters of nine tenths of the faces, then of the others on top of them."""
    old = f.where("id % 10 <> 3")
    labels = vectors.extended_clusters(old, old, f.sparkSession.createDataFrame([], "node long, component long"), 0.38)
    return vectors.extended_clusters(f, f.where("id % 10 = 3"), labels, 0.38)


@_add("vec_5_centroids", "faces_fx", ", x AS (SELECT cluster_id, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM faces_fx WHERE cluster_id IS NOT NULL), m AS (SELECT cluster_id, i, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL), n AS (SELECT cluster_id, sqrt(sum(v * v)) AS n FROM m GROUP BY ALL) SELECT cluster_id, i - 1 AS i, round(v / n, 6) AS x FROM m JOIN n USING (cluster_id)")
def _(f):
    return vectors.centroids(f).select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@_add("vec_9_best_faces", "faces_fx", ", r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY quality DESC, id) AS k FROM faces_fx WHERE cluster_id IS NOT NULL AND quality IS NOT NULL) SELECT cluster_id, id, quality FROM r WHERE k = 1")
def _(f):
    return vectors.best_faces(f)


@_add("vec_13_detection_work", "images_fx faces_fx metrics_fx", " SELECT id FROM images_fx SEMI JOIN (SELECT image_id AS id FROM metrics_fx WHERE faces > 0) USING (id) ANTI JOIN (SELECT image_id AS id FROM faces_fx) USING (id)")
def _(i, f, m):
    return vectors.detection_work(i, f, m)


# ---- reconciling, organising, changes

_FILES = ", files_fx AS (SELECT CASE WHEN id % 10 IN (1, 2) THEN concat(path, '.moved') ELSE path END AS path, CASE WHEN id % 10 = 3 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN id % 10 = 2 THEN concat(content_hash, 'x') ELSE content_hash END AS content_hash, size_bytes, capture_s, camera_model FROM images_fx WHERE id % 10 <> 0)"


def _files(i: DataFrame) -> DataFrame:
    k = F.col("id") % 10
    return i.where(k != 0).select(F.when(k.isin(1, 2), F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), F.when(k == 3, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), F.when(k == 2, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), "size_bytes", "capture_s", "camera_model")


@_add("jn_1_pending", "images_fx", _FILES + " SELECT f.path, f.mtime FROM files_fx f LEFT JOIN images_fx i ON i.path = f.path WHERE i.path IS NULL OR i.mtime IS NULL OR i.mtime <> f.mtime")
def _(i):
    return reconcile.pending(_files(i).select("path", "mtime"), i)


@_add(
    "jn_2_reconcile",
    "images_fx",
    ", copies AS (SELECT * REPLACE (concat('v2:', md5(CAST(id // 40 AS VARCHAR))) AS content_hash) FROM images_fx)"
    + _FILES.replace("images_fx", "copies")
    + """, gone AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY id) AS k FROM copies ANTI JOIN files_fx USING (path)),
fresh AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM files_fx ANTI JOIN copies USING (path)),
h AS (SELECT g.id, f.path AS np FROM gone g JOIN fresh f ON f.content_hash = g.content_hash AND f.k = g.k),
s AS (SELECT size_bytes, capture_s, camera_model, min(path) AS np FROM fresh WHERE path NOT IN (SELECT np FROM h) AND capture_s IS NOT NULL AND camera_model IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
y AS (SELECT min(g.id) AS id, s.np FROM gone g JOIN s ON g.size_bytes = s.size_bytes AND g.capture_s = s.capture_s AND g.camera_model = s.camera_model WHERE g.id NOT IN (SELECT id FROM h) GROUP BY s.np),
moved AS (SELECT * FROM h UNION ALL SELECT id, min(np) FROM y GROUP BY id)
SELECT id, path, 'kept' AS status FROM copies SEMI JOIN files_fx USING (path) UNION ALL SELECT id, np, 'rehoused' FROM moved UNION ALL SELECT id, path, 'removed' FROM gone WHERE id NOT IN (SELECT id FROM moved)""",
)
def _(i):
    """Up to forty images have one content, of which some are moved and some are gone."""
    i = i.withColumn("content_hash", F.concat(F.lit("v2:"), F.md5(F.expr("id div 40").cast("string"))))
    return reconcile.reconcile(_files(i), i)


@_add("jn_3_orphans", "images_fx", _FILES + " SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM files_fx ANTI JOIN images_fx USING (content_hash)")
def _(i):
    return reconcile.orphans(_files(i), i)


_NAMED = "concat_ws('/', '/out', coalesce(strftime(make_timestamp(capture_s * 1000000), '%Y/%m'), '_undated'), " + _SAFE.format("camera_make") + ", split_part(path, '/', 5))"


@_add("org_1_plan", "images_fx", f", t AS (SELECT id, path, {_NAMED} AS target FROM images_fx), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS k FROM t) SELECT id, path AS source, CASE WHEN k > 1 THEN concat(regexp_replace(target, '\\.[^./]+$', ''), '__', substr(sha1(path), 1, 6), regexp_extract(target, '\\.[^./]+$')) ELSE target END AS target FROM r")
def _(i):
    return reconcile.organize_plan(i, "/out", ["date:YYYY/MM", "camera:make"])


@_add(
    "org_1_existing",
    "images_fx",
    f""", t AS (SELECT id, path, {_NAMED} AS target FROM images_fx), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) > 1 OR target IN (SELECT target FROM t WHERE id % 5 = 0) AS again FROM t)
SELECT id, path AS source, CASE WHEN again THEN concat(regexp_replace(target, '\\.[^./]+$', ''), '__', substr(sha1(path), 1, 6), regexp_extract(target, '\\.[^./]+$')) ELSE target END AS target FROM r""",
)
def _(i):
    """Some of the targets hold a file already."""
    there = reconcile.organize_plan(i, "/out", ["date:YYYY/MM", "camera:make"]).where("id % 5 = 0 AND target NOT LIKE '%\\_\\_%'").select(F.col("target").alias("path"))
    plain = i.where("id % 5 = 0").select(F.concat_ws("/", F.lit("/out"), T.token("date:YYYY/MM"), T.token("camera:make"), F.element_at(F.split("path", "/"), -1)).alias("path"))
    return reconcile.organize_plan(i, "/out", ["date:YYYY/MM", "camera:make"], there.union(plain))


@_add(
    "mut_1_upsert",
    "images_fx",
    """, base AS (SELECT id, path, size_bytes, lens_model FROM images_fx WHERE id % 3 <> 0), top AS (SELECT max(id) AS m FROM base),
fresh AS (SELECT path, row_number() OVER (ORDER BY path) AS n FROM images_fx WHERE id % 21 = 0)
SELECT id, path, CASE WHEN id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN id % 7 = 0 THEN NULL ELSE lens_model END AS lens_model FROM base
UNION ALL SELECT m + n, f.path, size_bytes + 1, NULL FROM fresh f JOIN images_fx i ON i.path = f.path, top""",
)
def _(i):
    """Images by path: known ones keep their id and lose the lens that is null by now, new ones get the next ids."""
    i = i.select("id", "path", "size_bytes", "lens_model")
    new = i.where("id % 7 = 0").select("path", (F.col("size_bytes") + 1).alias("size_bytes"), F.lit(None).cast("string").alias("lens_model"))
    return mutate.upsert_images(i.where("id % 3 <> 0"), new)


@_add("mut_8_archive", "images_fx metrics_fx", _DECIDED + " SELECT path AS original_path, id AS image_id FROM images_fx JOIN verdicts_fx ON image_id = id WHERE verdict = 'reject' AND path NOT LIKE '%.photoslibrary%'")
def _(i, m):
    return mutate.archive_rejects(i, m, _verdicts(m))[0].select("original_path", "image_id")


@_add("pipe_3_demoted", "images_fx metrics_fx", _DECIDED.replace("WITH", "") + ", mem AS (SELECT image_id, image_id % 3 = 0 AS is_best FROM metrics_fx) SELECT v.image_id, CASE WHEN NOT is_best AND verdict = 'keeper' AND NOT user_override THEN 'review' ELSE verdict END AS verdict, CASE WHEN NOT is_best AND verdict = 'keeper' AND NOT user_override THEN 'yellow' ELSE label END AS label FROM verdicts_fx v JOIN mem ON mem.image_id = v.image_id")
def _(i, m):
    members = m.select(F.expr("image_id div 3").alias("burst_id"), "image_id", (F.col("image_id") % 3 == 0).alias("is_best"))
    return bursts.demote(_verdicts(m), members).select("image_id", "verdict", "label")


# ---- detections


@_add("fn_14_merge_animals", "images_fx", ", d AS (SELECT id, CASE id % 3 WHEN 0 THEN ['cat'] WHEN 1 THEN ['dog'] ELSE [] END AS a, CASE id % 2 WHEN 0 THEN ['dog', 'car', 'bird', 'dog'] ELSE ['cat'] END AS o FROM images_fx) SELECT id, array_to_string(list_sort(list_distinct(list_concat(a, list_filter(o, lambda x: x IN ('bird', 'cat', 'dog'))))), ',') AS species FROM d")
def _(i):
    animals = "CASE id % 3 WHEN 0 THEN array(named_struct('species', 'cat', 'confidence', 0.9D)) WHEN 1 THEN array(named_struct('species', 'dog', 'confidence', 0.8D)) END"
    objects = "transform(CASE id % 2 WHEN 0 THEN array('dog', 'car', 'bird', 'dog') ELSE array('cat') END, x -> named_struct('kind', x, 'confidence', 0.5D))"
    merged = D.merge_animals(F.expr(animals), F.expr(objects))
    return i.select("id", F.array_join(F.array_sort(F.transform(merged, lambda a: a["species"])), ",").alias("species"))


@_add(
    "fn_18_content_type",
    "images_fx",
    ", x AS (SELECT id, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cam, CAST(id % 101 AS DOUBLE) / 100e0 AS doc, id % 7 AS n, least(1e0, CAST((id % 7) * 200 * (id % 90) AS DOUBLE) / 1000000e0) AS ta, id * 37 % 512 AS colours FROM images_fx),"
    " k AS (SELECT id, CASE WHEN cam AND doc >= 0.7e0 AND ta > 0.01e0 THEN 'document' WHEN NOT cam AND (colours < 256 OR (ta >= 0.04e0 AND n >= 4)) THEN 'screenshot' WHEN NOT cam THEN 'photo' WHEN ta >= 0.04e0 AND colours < 256 THEN 'screenshot' ELSE 'photo' END AS kind, cam, doc, ta FROM x)"
    " SELECT id, kind, round(CASE kind WHEN 'document' THEN doc WHEN 'screenshot' THEN least(0.99e0, ta + CASE WHEN NOT cam THEN 0.8e0 ELSE 0.7e0 END) ELSE CASE WHEN NOT cam THEN 0.7e0 ELSE 0.8e0 END END, 9) AS conf FROM k",
)
def _(i):
    boxes = "transform(slice(sequence(1, 7), 1, CAST(id % 7 AS INT)), k -> named_struct('x0', k * 10, 'y0', 0, 'x1', k * 10 + 100, 'y1', CAST(id % 90 AS INT) * 2))"
    c = D.content_type(F.expr("CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END"), F.expr("CAST(id % 101 AS DOUBLE) / 100D"), F.expr(boxes), F.expr("id * 37 % 512"), F.lit(1000), F.lit(1000))
    return i.select("id", c.alias("c")).select("id", "c.kind", F.round("c.conf", 9).alias("conf"))


@_add(
    "fn_19_eye_report",
    "images_fx",
    ", e AS (SELECT id, k, CAST(id * k * 7 % 50 AS DOUBLE) / 100e0 AS le, CAST(id * k * 11 % 50 AS DOUBLE) / 100e0 AS re, CAST(id * k * 13 % 70 AS DOUBLE) / 100e0 AS b, (id + k) % 3 = 0 AS occ FROM images_fx, (SELECT unnest(range(1, 5)) AS k) WHERE k <= id % 5),"
    " g AS (SELECT id, count(*) AS faces, count(*) FILTER (b >= 0.5e0 OR least(le, re) < 0.2e0) AS closed, count(*) FILTER ((b >= 0.5e0 OR least(le, re) < 0.2e0) AND occ) AS occluded, min(least(le, re)) AS min_ear, max(b) AS max_blink FROM e GROUP BY id)"
    " SELECT i.id, coalesce(faces, 0) AS faces, coalesce(closed, 0) AS closed_count, coalesce(occluded, 0) AS occluded_count, coalesce(closed, 0) > 0 AS any_closed, min_ear, max_blink FROM images_fx i LEFT JOIN g ON g.id = i.id",
)
def _(i):
    share = lambda by, of: f"CAST(id * k * {by} % {of} AS DOUBLE) / 100D"
    face = f"named_struct('left_ear', {share(7, 50)}, 'right_ear', {share(11, 50)}, 'left_blink', {share(13, 70)}, 'right_blink', 0D, 'smile', 0D, 'frown', 0D, 'occluded', (id + k) % 3 = 0)"
    e = D.eye_report(F.expr(f"transform(slice(sequence(1, 4), 1, CAST(id % 5 AS INT)), k -> {face})"))
    return i.select("id", e.alias("e")).select("id", *[f"e.{c}" for c in ("faces", "closed_count", "occluded_count", "any_closed", "min_ear", "max_blink")])


@_add("vec_11_reassign", "faces_fx", " SELECT id, CASE WHEN id % 12 = 0 THEN NULL WHEN id % 6 = 0 THEN 3 ELSE cluster_id END AS cluster_id FROM faces_fx")
def _(f):
    patch = f.where("id % 6 = 0").select("id", F.expr("CASE WHEN id % 12 <> 0 THEN 3 END").cast(dict(f.dtypes)["cluster_id"]).alias("cluster_id"))
    return vectors.reassign_faces(f, patch).select("id", "cluster_id")


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """library_id, verdict, n over all images."""
    i, m = view(spark, sf_dir, "images_fx"), view(spark, sf_dir, "metrics_fx")
    return decide.decide(m).join(i.select(F.col("id").alias("image_id"), "library_id"), "image_id").groupBy("library_id", "verdict").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _ALL.items()} | {"flagship_verdict_counts": verdict_counts}


def oracle_sql() -> dict[str, str]:
    flagship = duckdb_with("images_fx", "metrics_fx") + _SHEET + " SELECT library_id, verdict, count(*) AS n FROM j GROUP BY ALL"
    return {k: s for k, (_, s) in _ALL.items() if s} | {"flagship_verdict_counts": flagship}
