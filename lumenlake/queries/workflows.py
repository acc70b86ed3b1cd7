"""More of the catalogue's queries: values of files and faces, details, groups, labels, organising and changes of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.functions import detections as D
from lumenlake.functions import tokens as T
from lumenlake.functions import values as V
from lumenlake.operators import bursts, catalogue, decide, events, mutate, reconcile, vectors
from lumenlake.plans.pipelines import faces_run
from lumenlake.queries.registry import _BOTH, _BURST_SCORE, _COS, _DECIDED, _FLAGS, _NAMED, _REACH, _SHEET, _add, _verdicts
from lumenlake.shared import materialize
from lumenlake.sources import metrics as measures
from lumenlake.sources.files import parse_metrics

_MEM = ", mem AS (SELECT image_id // 3 AS burst_id, image_id, image_id % 3 = 0 AS is_best FROM metrics_fx)"
_FOLDER = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def _members(m: DataFrame) -> DataFrame:
    return m.select(F.expr("image_id div 3").alias("burst_id"), "image_id", (F.col("image_id") % 3 == 0).alias("is_best"))


# ---- values


@_add("src_5_fn_15_json", "props_fx", " SELECT id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS text FROM props_fx")
def _(p):
    text = F.get_json_object("props", "$.k").alias("text")
    return parse_metrics(p.select("id", text, "props"), "k int", "props")


_ESCAPE = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@_add(
    "src_7_sidecars",
    "images_fx metrics_fx",
    _SHEET
    + " SELECT concat(path, '.xmp') AS sidecar_path, concat('<x:xmpmeta xmlns:x=\"adobe:ns:meta/\"><rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\"><rdf:Description xmp:Rating=\"', stars, '\" xmp:Label=\"', upper(label[1]), label[2:], '\"><verdict>', verdict, '</verdict><reasons><rdf:Bag>', array_to_string(list_transform(reasons, lambda r: concat('<rdf:li>', "
    + _ESCAPE.format("r")
    + ", '</rdf:li>')), ''), '</rdf:Bag></reasons></rdf:Description></rdf:RDF></x:xmpmeta>') AS body FROM j WHERE library_id = 2",
)
def _(i, m):
    return catalogue.sidecars(i, _verdicts(m), library_id=2)


@_add("pix_11_thirds", "images_fx", ", b AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE id * 7 % 3600 + 100 END AS cx, id * 11 % 2700 + 40 AS cy FROM images_fx), d AS (SELECT id, least(sqrt((cx - 4000 / 3e0) ** 2 + (cy - 1000) ** 2), sqrt((cx - 8000 / 3e0) ** 2 + (cy - 1000) ** 2), sqrt((cx - 4000 / 3e0) ** 2 + (cy - 2000) ** 2), sqrt((cx - 8000 / 3e0) ** 2 + (cy - 2000) ** 2)) AS d, cx FROM b) SELECT id, CASE WHEN cx IS NOT NULL THEN round(d / 2500, 9) END AS thirds_offset FROM d")
def _(i):
    x = F.when(F.col("id") % 13 != 0, F.col("id") * 7 % 3600)
    return i.select("id", F.round(V.thirds_offset(x, F.col("id") * 11 % 2700, F.lit(200), F.lit(80), F.lit(4000), F.lit(3000)), 9).alias("thirds_offset"))


@_add("fn_9_quality_tokens", "images_fx metrics_fx", _SHEET + " SELECT id, verdict AS v, CASE WHEN stars = 0 THEN '_unknown' ELSE concat(stars, '-star') END AS s FROM j")
def _(i, m):
    joined = i.join(_verdicts(m).withColumnRenamed("image_id", "id"), "id")
    return joined.select("id", T.token("quality:verdict").alias("v"), T.token("quality:stars").alias("s"))


@_add("fn_10_more_tokens", "metrics_fx", " SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'no-flash' ELSE '_unknown' END AS flash, CASE WHEN image_id % 4 = 0 THEN '_unknown' ELSE concat('event_', image_id % 7) END AS event, CASE image_id % 5 WHEN 0 THEN 'traffic_light' WHEN 1 THEN '_unknown' ELSE 'dog' END AS object FROM metrics_fx")
def _(m):
    rows = m.selectExpr("image_id", "CASE image_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flash_fired", "CASE WHEN image_id % 4 <> 0 THEN concat('event/', image_id % 7) END AS event_label", "CASE image_id % 5 WHEN 0 THEN 'traffic light' WHEN 1 THEN ' ' ELSE 'dog' END AS object_class")
    return rows.select("image_id", T.token("flash").alias("flash"), T.token("event").alias("event"), T.token("object:class").alias("object"))


_TEXT = "CASE id % 4 WHEN 0 THEN concat('2024:0', {0}, ':1', {0}, ' 0', {0}, ':20:30') WHEN 1 THEN concat(' 2023-1', {1}, '-0', {0}, ' 11:0', {0}, ':00 ') WHEN 2 THEN concat('2022:0', {0}, ':0', {0}) ELSE 'unreadable' END"


@_add("fn_16_exif", "images_fx", ", t AS (SELECT id, trim(" + _TEXT.format("(id % 9 + 1)", "(id % 3)") + ") AS t FROM images_fx) SELECT id, try_strptime(t, ['%Y:%m:%d %H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y:%m:%d']) AS taken, round(CASE WHEN id % 3 < 2 THEN -1 ELSE 1 END * (id % 90 + (id % 60) / 60e0 + (id % 59) / 3600e0), 9) + 0e0 AS degrees FROM t")
def _(i):
    text = F.expr(_TEXT.format("CAST(id % 9 + 1 AS STRING)", "CAST(id % 3 AS STRING)"))
    ref = F.expr("CASE id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'W' ELSE 'E' END")
    return i.select("id", V.exif_time(text).alias("taken"), (F.round(V.dms(F.col("id") % 90, F.col("id") % 60, F.col("id") % 59, ref), 9) + F.lit(0.0)).alias("degrees"))


@_add("fn_17_face_quality", "metrics_fx", ", p AS (SELECT *, CASE WHEN image_id % 5 = 0 THEN NULL ELSE greatest(abs(image_id % 90 - 45), abs(image_id % 70 - 35)) END AS turn FROM metrics_fx) SELECT image_id, round(0.3e0 * sharp_score + 0.2e0 * least(1e0, face_w * face_h / 600000e0) + 0.3e0 * least(1e0, laplacian_var / 500e0) + 0.2e0 * coalesce(greatest(0e0, 1 - turn / 45e0), 1e0), 9) AS quality FROM p")
def _(m):
    turn = lambda by: F.when(F.col("image_id") % 5 != 0, F.col("image_id") % by - by // 2)
    return m.select("image_id", F.round(V.face_quality(F.col("sharp_score"), F.col("face_w"), F.col("face_h"), F.lit(4000), F.lit(3000), F.col("laplacian_var"), turn(90), turn(70)), 9).alias("quality"))


@_add("fn_20_focus_behind", "metrics_fx", " SELECT image_id, laplacian_var < 200 AND tenengrad > 1.3e0 * laplacian_var AS behind FROM metrics_fx")
def _(m):
    return m.select("image_id", V.focus_on_background("laplacian_var", "tenengrad").alias("behind"))


@_add(
    "fn_21_primary_subjects",
    "images_fx",
    ", b AS (SELECT id, k, k * 200 AS x, 100 AS y, 10 + id * k % 160 AS s FROM images_fx, (SELECT unnest(range(1, 4)) AS k) WHERE k <= id % 4),"
    " sal AS (SELECT id, 0 AS x, 0 AS y, 300 + id % 5 * 100 AS w, 300 + id % 3 * 200 AS h FROM images_fx WHERE id % 3 <> 0), per AS (SELECT id, 100 AS x, 50 AS y, 400 AS w, 350 AS h FROM images_fx WHERE id % 7 < 3),"
    " front AS (SELECT * FROM sal WHERE w * h <= 250000 UNION ALL SELECT * FROM per),"
    " ins AS (SELECT DISTINCT b.id, k, s FROM b JOIN front f ON f.id = b.id WHERE greatest(0, least(b.x + s, f.x + f.w) - greatest(b.x, f.x)) * greatest(0, least(b.y + s, f.y + f.h) - greatest(b.y, f.y)) > 0.5e0 * s * s),"
    " tall AS (SELECT id, max(s * s) AS t, (list(s * s ORDER BY s DESC)) AS areas FROM b GROUP BY id), own AS (SELECT id, list(s * s ORDER BY s DESC) AS areas FROM ins GROUP BY id), box AS (SELECT id, max(w * h) AS a FROM (SELECT id, w, h FROM sal UNION ALL SELECT id, w, h FROM per) GROUP BY id)"
    " SELECT i.id, CASE WHEN t IS NULL THEN coalesce(CAST(a AS VARCHAR), '') WHEN own.areas IS NOT NULL THEN array_to_string(own.areas, ',') WHEN t < 500 OR len(list_filter(tall.areas, lambda z: z >= 0.55e0 * t)) >= 3 THEN '' ELSE array_to_string(list_filter(tall.areas, lambda z: z >= 0.55e0 * t), ',') END AS areas FROM images_fx i LEFT JOIN tall ON tall.id = i.id LEFT JOIN own ON own.id = i.id LEFT JOIN box ON box.id = i.id",
)
def _(i):
    box = lambda x0, y0, x1, y1: f"named_struct('x0', {x0}, 'y0', {y0}, 'x1', {x1}, 'y1', {y1})"
    side = "CAST(10 + id * k % 160 AS DOUBLE)"
    faces = F.expr(f"transform(slice(sequence(1, 3), 1, CAST(id % 4 AS INT)), k -> named_struct('kind', 'face', 'x', CAST(k * 200 AS DOUBLE), 'y', 100D, 'w', {side}, 'h', {side}))")
    salient = F.expr(f"CASE WHEN id % 3 <> 0 THEN {box('0L', '0L', '300 + id % 5 * 100', '300 + id % 3 * 200')} END")
    persons = F.expr(f"CASE WHEN id % 7 < 3 THEN array({box('100L', '50L', '500L', '400L')}) ELSE array() END")
    found = D.primary_subjects(faces, salient, persons, F.lit(1000), F.lit(1000))
    return i.select("id", F.array_join(F.transform(found, lambda s: (s["w"] * s["h"]).cast("long").cast("string")), ",").alias("areas"))


# ---- decisions, listings


def _as_json(m: DataFrame) -> DataFrame:
    """image_id, metrics_json: the fixture's measures as a pipeline stores them, with as many face subjects as faces and one
    more subject that is wider than any."""
    c, x = F.col, F.expr
    sharp = lambda score: F.struct("laplacian_var", "tenengrad", "fft_anisotropy", c(score).alias("score"), "blur_angle_deg")
    faces = x("transform(sequence(1, 8), k -> named_struct('bbox', array(10 * k, 20, cast(100 + (image_id * 59 + k * 131) % 900 as int), cast(100 + (image_id * 67 + k * 37) % 300 as int)), 'kind', 'face', 'confidence', 0.9d, 'is_primary', k = 1))")
    other = x("array(named_struct('bbox', array(0, 0, 2000, 1300), 'kind', 'saliency', 'confidence', 0.5d, 'is_primary', false))")
    struct = lambda *names: F.struct(*names)
    fields = {
        "sharpness": sharp("sharp_score"),
        "subject_sharpness": F.when(c("subject_sharp_score").isNotNull(), sharp("subject_sharp_score")),
        "subjects": F.concat(other, F.filter(faces, lambda s: s["bbox"][0] <= 10 * c("faces"))),
        "exposure": struct("mean_luma", "dynamic_range", "clipped_highlight", "clipped_shadow"),
        "eyes": struct("faces", "closed_count", "any_closed", "occluded_count", "min_ear", "max_blink", "max_smile"),
        "composition": struct("horizon_tilt_deg", "thirds_offset"),
        "aesthetic_score": c("aesthetic_score"),
        "aesthetic_source": c("aesthetic_source"),
        "color": F.struct(F.array(F.array("dom_r", "dom_g", "dom_b")).alias("dominant"), "temperature", "saturation", "cast_strength", "cast_hue"),
        "decoded_size": x("array(2000, 1333)"),
        "depth": struct("focus_on_background"),
        "scene": F.struct(c("scene").alias("primary")),
        "content_type": F.struct(c("content_type").alias("class")),
        "animals": x("CASE WHEN image_id % 7 = 0 THEN array(named_struct('species', 'cat', 'confidence', 0.8d)) END"),
    }
    return m.select("image_id", F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("metrics_json"))


_NESTED = """, faced AS (SELECT image_id AS face_of, list_max(list_transform(range(1, faces + 1), lambda k: {'w': 100 + (image_id * 59 + k * 131) % 900, 'h': 100 + (image_id * 67 + k * 37) % 300})) AS face FROM metrics_fx),
nested_fx AS (SELECT m.* REPLACE (CAST(face.w AS INTEGER) AS face_w, CAST(face.h AS INTEGER) AS face_h) FROM metrics_fx m JOIN faced ON face_of = image_id)"""


@_add("dec_3_nested_metrics", "metrics_fx", _NESTED + _DECIDED.replace("metrics_fx", "nested_fx") + " SELECT v.image_id, verdict, stars, label, reasons, warnings, round(score, 9) AS score, face_w, face_h, dom_r, scene, content_type, CASE WHEN v.image_id % 7 = 0 THEN ['cat'] END AS animals FROM verdicts_fx v JOIN nested_fx n ON n.image_id = v.image_id")
def _(m):
    """From stored JSON text to verdicts; the chosen face comes out of the subjects."""
    wide = measures.flat(measures.parsed(_as_json(m)))
    return decide.decide(wide).withColumn("score", F.round("score", 9)).join(wide.select("image_id", "face_w", "face_h", "dom_r", "scene", "content_type", "animals"), "image_id")


@_add("dec_8_reclassify", "metrics_fx", _DECIDED + ", new AS (WITH " + _DECIDED.lstrip(", \n").replace("0.55e0", "0.62e0") + " SELECT * FROM verdicts_fx) SELECT image_id, CASE WHEN o.user_override THEN o.verdict ELSE n.verdict END AS verdict, CASE WHEN o.user_override THEN o.stars ELSE n.stars END AS stars, CASE WHEN o.user_override THEN o.reasons ELSE n.reasons END AS reasons, o.user_override FROM verdicts_fx o JOIN new n USING (image_id)")
def _(m):
    return decide.reclassify(m, _verdicts(m), decide.Thresholds(sharp_keeper=0.62)).select("image_id", "verdict", "stars", "reasons", "user_override")


@_add("q_2_details", "images_fx metrics_fx", _SHEET + _MEM + " SELECT id, path, verdict, stars, m.sharp_score AS sharp_score, burst_id, is_best, CASE id % 4 WHEN 0 THEN 'cat,dog' WHEN 1 THEN 'cat' WHEN 2 THEN 'dog' ELSE '' END AS species FROM j LEFT JOIN mem ON mem.image_id = j.id LEFT JOIN metrics_fx m ON m.image_id = j.id")
def _(i, m):
    seen = m.withColumn("animals", F.expr("CASE WHEN image_id % 4 < 2 THEN array(named_struct('species', 'cat', 'confidence', 0.9D)) END"))
    seen = seen.withColumn("objects", F.expr("CASE WHEN image_id % 2 = 0 THEN array(named_struct('kind', 'dog', 'confidence', 0.5D), named_struct('kind', 'car', 'confidence', 0.5D)) END"))
    out = catalogue.image_details(i.select("id"), i, _verdicts(m).drop("label"), seen, _members(m))
    return out.select("id", "path", "verdict", "stars", "sharp_score", "burst_id", "is_best", F.array_join(F.array_sort(F.transform("animals", lambda a: a["species"])), ",").alias("species"))


#: name, the filter, and the same as SQL
_EACH = (
    ("verdict", {"verdict": "keeper"}, "verdict = 'keeper'"),
    ("stars", {"stars_min": 4}, "stars >= 4"),
    ("sharpness", {"sharpness_min": 0.5}, "sharp_score >= 0.5e0"),
    ("aesthetic", {"aesthetic_min": 0.6}, "coalesce(aesthetic_score, 0) >= 0.6e0"),
    ("eyes", {"reason_eyes": True}, "said LIKE '%eyes%'"),
    ("exposure", {"reason_exposure": True}, "said LIKE '%exposed%'"),
    ("tilt", {"reason_tilt": True}, "said LIKE '%tilt%'"),
    ("cast", {"reason_cast": True}, "said LIKE '%cast%'"),
    ("content", {"content_type": "photo"}, "coalesce(content_type, 'photo') = 'photo'"),
    ("scene", {"scene": "beach"}, "scene = 'beach'"),
    ("temperature", {"temperature": "warm"}, "temperature = 'warm'"),
    ("saturation", {"saturation": "vivid"}, "saturation = 'vivid'"),
    ("hue", {"cast_hue": "red"}, "cast_hue = 'red'"),
    ("camera", {"camera": "EOS R5"}, "camera_model = 'EOS R5'"),
    ("iso", {"iso": "high"}, "iso > 1600 AND iso <= 6400"),
    ("iso_low", {"iso": "low"}, "coalesce(iso, 0) <= 200"),
    ("aperture", {"aperture": "wide"}, "f_number > 0 AND f_number < 2.8e0"),
    ("square", {"orientation": "square"}, "abs(width - height) <= 0.02e0 * greatest(width, height)"),
    ("landscape", {"orientation": "landscape"}, "width IS NULL OR height IS NULL OR (width > height AND abs(width - height) > 0.02e0 * greatest(width, height))"),
    ("from", {"date_from_s": 1704153600}, "capture_s >= 1704153600"),
    ("to", {"date_to_s": 1704153600}, "capture_s <= 1704153600"),
    ("path", {"path_contains": "IMG_2"}, "path ILIKE '%img_2%'"),
    ("burst", {"burst_only": True}, "burst_id IS NOT NULL"),
    ("best", {"burst_best": True}, "is_best"),
)
_WIDE = _SHEET + _MEM + ", w AS (SELECT j.*, m.sharp_score, m.aesthetic_score, m.content_type, m.scene, m.temperature, m.saturation, m.cast_hue, mem.burst_id, mem.is_best, lower(array_to_string(list_concat(reasons, warnings), '|')) AS said FROM j JOIN metrics_fx m ON m.image_id = j.id LEFT JOIN mem ON mem.image_id = j.id AND j.id % 5 <> 0)"


def _wide(i: DataFrame, m: DataFrame) -> DataFrame:
    return catalogue.list_images(i, _verdicts(m).drop("label"), m, _members(m).where("image_id % 5 <> 0"))


@_add("q_3_each_filter", "images_fx metrics_fx", _WIDE + " " + " UNION ALL ".join(f"SELECT '{name}' AS name, id FROM w WHERE {sql}" for name, _, sql in _EACH))
def _(i, m):
    # every filter's own predicates side by side, over one pass
    hit = lambda f: reduce(lambda a, b: a & b, catalogue.predicates(catalogue.Filters(**f)))
    names = F.array_compact(F.array(*[F.when(hit(f), F.lit(name)) for name, f, _ in _EACH]))
    return _wide(i, m).select(F.explode(names).alias("name"), "id")


@_add("q_5_sort_keys", "images_fx metrics_fx", _WIDE + " SELECT w.id, CAST(coalesce(capture_s, 0) AS DOUBLE) AS taken, coalesce(aesthetic_score, 0e0) AS aesthetic, sharp_score AS sharpness, CAST(stars AS DOUBLE) AS stars, CAST(coalesce(iso, 0) AS DOUBLE) AS iso, CAST(coalesce(exposure_time, 0) AS DOUBLE) AS exposure, CAST(coalesce(f_number, 999) AS DOUBLE) AS aperture, CASE temperature WHEN 'cool' THEN 1 WHEN 'neutral' THEN 2 WHEN 'warm' THEN 3 ELSE 0 END AS temperature, split_part(path, '/', 5) AS filename FROM w")
def _(i, m):
    key = lambda k, n=None: catalogue.sort_key(k).alias(n or k)
    return _wide(i, m).select("id", key("timestamp", "taken"), *map(key, ("aesthetic", "sharpness", "stars", "iso", "exposure", "aperture", "temperature", "filename")))


@_add("q_4_scope", "images_fx metrics_fx", " SELECT id, path FROM images_fx WHERE library_id = 3 AND id IN (SELECT image_id FROM metrics_fx WHERE aesthetic_score > 0.5e0)")
def _(i, m):
    return catalogue.scope(i, m.where("aesthetic_score > 0.5").select(F.col("image_id").alias("id")), 3).select("id", "path")


@_add("q_11_cached_verdicts", "images_fx metrics_fx", _SHEET + " SELECT path, id AS image_id, verdict, stars, label FROM j WHERE f_number > 3 ORDER BY path")
def _(i, m):
    return catalogue.cached_verdicts(i.where("f_number > 3").select("path"), i, _verdicts(m))


@_add("q_12_burst_counts", "images_fx metrics_fx", _MEM + " SELECT burst_id, count(*) AS n FROM mem JOIN images_fx ON id = image_id WHERE library_id = 2 GROUP BY burst_id")
def _(i, m):
    return catalogue.burst_counts(_members(m), i, 2)


@_add("q_13_bursts_per_library", "images_fx metrics_fx", _MEM + " SELECT library_id, count(DISTINCT burst_id) AS bursts FROM mem JOIN images_fx ON id = image_id WHERE library_id IS NOT NULL GROUP BY library_id")
def _(i, m):
    return catalogue.bursts_per_library(_members(m), i)


@_add("q_13_bursts_with_members", "metrics_fx", _MEM + " SELECT burst_id, count(*) AS n, list(image_id ORDER BY image_id) AS ids, list(is_best ORDER BY image_id) AS best FROM mem GROUP BY burst_id HAVING count(*) >= 2")
def _(m):
    return catalogue.bursts_with_members(_members(m)).select("burst_id", "n", F.col("members.image_id").alias("ids"), F.col("members.is_best").alias("best"))


def _errors(i: DataFrame) -> DataFrame:
    return i.where("iso IS NULL").select("path", F.concat(F.lit("no iso in "), "path").alias("error"), "library_id", F.col("mtime").alias("seen_s"))


_ERR = ", err AS (SELECT path, concat('no iso in ', path) AS error, library_id, mtime AS seen_s FROM images_fx WHERE iso IS NULL)"


@_add("q_15_errors", "images_fx", _ERR + " SELECT * FROM err WHERE library_id = 4 ORDER BY seen_s DESC, path")
def _(i):
    return catalogue.list_errors(_errors(i), 4, "seen_s")


@_add("q_15_cleared", "images_fx", _ERR + " SELECT * FROM err WHERE library_id IS DISTINCT FROM 4 AND library_id IS DISTINCT FROM 2")
def _(i):
    return catalogue.clear_errors(_errors(i), i.where("library_id IN (2, 4)").select(F.col("library_id").alias("id")).distinct())


@_add("q_16_stage_times", "metrics_fx", " SELECT count(*) AS n, round(sum(laplacian_var), 6) AS decode_s, round(sum(tenengrad), 6) AS ml_s, round(count(*) / (sum(laplacian_var) + sum(tenengrad)), 9) AS images_per_second FROM metrics_fx")
def _(m):
    t = catalogue.stage_times(m.select(F.col("laplacian_var").alias("decode_s"), F.col("tenengrad").alias("ml_s")), ["decode_s", "ml_s"])
    return t.select("n", F.round("decode_s", 6).alias("decode_s"), F.round("ml_s", 6).alias("ml_s"), F.round("images_per_second", 9).alias("images_per_second"))


# ---- groups and events

_BITS2 = ", hx AS (SELECT id, capture_s, ('0x'||substr(phash,1,8))::bigint AS hi, ('0x'||substr(phash,9,8))::bigint AS lo FROM images_fx WHERE library_id = 2), half AS (SELECT a.id AS x, b.id AS y FROM hx a JOIN hx b ON a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 10 AND (abs(a.capture_s - b.capture_s) <= 3 OR (a.capture_s IS NULL AND b.capture_s IS NULL)))"
_GROUPS = _BITS2 + _BOTH + _REACH + f", {_FLAGS}, r AS (SELECT c, node, capture_s, round({_BURST_SCORE}, 9) AS s FROM comp JOIN images_fx ON id = node JOIN f ON image_id = node), k AS (SELECT c, row_number() OVER (ORDER BY t NULLS LAST, n) AS burst_id FROM (SELECT c, min(capture_s) AS t, arg_min(node, (coalesce(capture_s, 9e15), node)) AS n FROM r GROUP BY c)), grouped AS (SELECT burst_id, node AS image_id, row_number() OVER (PARTITION BY r.c ORDER BY s DESC, capture_s NULLS LAST, node) = 1 AS is_best FROM r JOIN k ON k.c = r.c), rest AS (SELECT mem.* FROM mem JOIN images_fx ON id = mem.image_id WHERE library_id IS DISTINCT FROM 2), after AS (SELECT * FROM rest UNION ALL SELECT burst_id + (SELECT coalesce(max(burst_id), 0) FROM rest), image_id, is_best FROM grouped)"


@_add("grp_6_regroup", "images_fx metrics_fx", _MEM + _GROUPS + " SELECT burst_id, image_id, is_best FROM after")
def _(i, m):
    new = bursts.group_bursts(i.where("library_id = 2"), m)
    return bursts.regroup_library(_members(m), i, new, 2)


@_add("grp_7_best_picks", "metrics_fx", _MEM + " SELECT burst_id, image_id, CASE WHEN burst_id % 4 = 0 AND burst_id * 3 + 2 <= (SELECT max(image_id) FROM metrics_fx) THEN image_id % 3 = 2 ELSE is_best END AS is_best FROM mem")
def _(m):
    picks = _members(m).where("burst_id % 2 = 0").groupBy("burst_id").agg(F.max("image_id").alias("last"))
    picks = picks.select("burst_id", F.when(F.col("burst_id") % 4 == 0, F.col("burst_id") * 3 + 2).otherwise(F.col("last") + 100).alias("image_id"))
    return bursts.apply_best_picks(_members(m), picks)


@_add("jn_6_orphan_bursts", "images_fx metrics_fx", _MEM + ", left_ AS (SELECT mem.* FROM mem JOIN images_fx ON id = image_id WHERE library_id <> 2) SELECT DISTINCT burst_id FROM mem WHERE burst_id IN (SELECT burst_id FROM left_)")
def _(i, m):
    members = _members(m)
    left = members.join(i.where("library_id <> 2").select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return bursts.orphan_bursts(members.select("burst_id").distinct(), left)


@_add("pipe_3_regroup", "images_fx metrics_fx", _MEM + _GROUPS + ", decided AS (WITH " + _DECIDED.lstrip(", \n") + " SELECT * FROM verdicts_fx), worse AS (SELECT image_id FROM after JOIN images_fx ON id = image_id WHERE library_id = 2 AND NOT is_best) SELECT d.image_id, CASE WHEN w.image_id IS NOT NULL AND verdict = 'keeper' AND NOT user_override THEN 'review' ELSE verdict END AS verdict, CASE WHEN w.image_id IS NOT NULL AND verdict = 'keeper' AND NOT user_override THEN 'yellow' ELSE label END AS label, a.burst_id, a.is_best FROM decided d LEFT JOIN worse w ON w.image_id = d.image_id LEFT JOIN after a ON a.image_id = d.image_id AND a.burst_id IN (SELECT burst_id FROM after)")
def _(i, m):
    members, known, verdicts = bursts.regroup(i, m, _verdicts(m), _members(m), 2)
    return verdicts.select("image_id", "verdict", "label").join(members.join(known, "burst_id", "left_semi"), "image_id", "left")


_GAPS = ", s AS (SELECT id, library_id, capture_s + id // 150 * 43200 AS t FROM images_fx WHERE capture_s IS NOT NULL), o AS (SELECT id, t, CASE WHEN t - lag(t) OVER (ORDER BY t, id) > 21600 THEN 1 ELSE 0 END AS n FROM s), g AS (SELECT id, t, CAST(sum(n) OVER (ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS event_id FROM o)"


def _spread(i: DataFrame) -> DataFrame:
    return i.withColumn("capture_s", F.expr("capture_s + id div 150 * 43200"))


@_add("evt_1_gaps", "images_fx", _GAPS + " SELECT event_id, printf('event-%04d', event_id) AS label, min(t) AS start_s, max(t) AS end_s FROM g GROUP BY event_id")
def _(i):
    return events.split_events(_spread(i))[0]


@_add("evt_1_members", "images_fx", _GAPS + " SELECT event_id, id AS image_id FROM g")
def _(i):
    return events.split_events(_spread(i))[1]


@_add("evt_2_labels", "images_fx", _GAPS + " SELECT id AS image_id, printf('event-%04d', event_id) AS event_label FROM g")
def _(i):
    return events.event_labels(*events.split_events(_spread(i)))


# ---- joins and organising

_VIDEOS = ", fs AS (SELECT path FROM images_fx UNION ALL SELECT concat(regexp_replace(path, '\\.[^./]+$', ''), CASE id % 3 WHEN 0 THEN '.mov' WHEN 1 THEN '.MP4' ELSE '.txt' END) FROM images_fx UNION ALL SELECT concat(regexp_replace(path, '\\.[^./]+$', ''), '.MOV') FROM images_fx WHERE id % 2 = 0)"


@_add("jn_4_live_pairs", "images_fx", _VIDEOS + ", p AS (SELECT path, regexp_replace(path, '\\.[^./]+$', '') AS stem, list_position(['.mov', '.MOV', '.mp4', '.MP4'], regexp_extract(path, '(\\.[^./]*)$', 1)) AS o FROM fs) SELECT i.path, arg_min(v.path, v.o) AS video FROM p i JOIN p v ON v.stem = i.stem AND v.o > 0 WHERE coalesce(i.o, 0) = 0 GROUP BY i.path")
def _(i):
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    ext = F.expr("CASE id % 3 WHEN 0 THEN '.mov' WHEN 1 THEN '.MP4' ELSE '.txt' END")
    files = i.select("path").union(i.select(F.concat(stem, ext))).union(i.where("id % 2 = 0").select(F.concat(stem, F.lit(".MOV"))))
    return reconcile.live_pairs(files).groupBy("path").agg(F.min("video").alias("video"))


_FAR = "pow(sin((radians(lat) - radians(gps_lat)) / 2), 2) + cos(radians(gps_lat)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(gps_lon)) / 2), 2)"


@_add("jn_5_nearest_place", "images_fx places_fx", f", s AS (SELECT DISTINCT gps_lat, gps_lon FROM images_fx WHERE gps_lat IS NOT NULL), b AS (SELECT gps_lat, gps_lon, min(struct_pack(d := round({_FAR}, 12), country := country, region := region, city := city)) AS b FROM s, places_fx GROUP BY ALL) SELECT id, b.country AS country, b.region AS region, b.city AS city FROM images_fx i LEFT JOIN b ON b.gps_lat = i.gps_lat AND b.gps_lon = i.gps_lon")
def _(i, p):
    return reconcile.nearest_place(i, p)


_PLAN = f", t AS (SELECT id, path, {_NAMED} AS target FROM images_fx), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY id) AS k FROM t), plan AS (SELECT id, path AS source, CASE WHEN k > 1 THEN concat(regexp_replace(target, '\\.[^./]+$', ''), '__', substr(sha1(path), 1, 6), regexp_extract(target, '\\.[^./]+$')) ELSE target END AS target FROM r)"


def _plan(i: DataFrame) -> DataFrame:
    return reconcile.organize_plan(i, "/out", ["date:YYYY/MM", "camera:make"])


@_add("org_2_apply", "images_fx", _PLAN + " SELECT id, target AS path FROM plan")
def _(i):
    return reconcile.apply_plan(i, _plan(i), "move", "run-1")[0].select("id", "path")


@_add("org_2_log", "images_fx", _PLAN + " SELECT 'run-1' AS run_id, 'copy' AS mode, source, target FROM plan")
def _(i):
    return reconcile.apply_plan(i, _plan(i), "copy", "run-1")[1].drop("image_id")


@_add("org_3_undo", "images_fx", " SELECT id, path, CAST(0 AS BIGINT) AS logged FROM images_fx")
def _(i):
    moved, log = reconcile.apply_plan(i, _plan(i), "move", "run-1")
    back, left = reconcile.undo_last(moved, log)
    return back.select("id", "path").crossJoin(F.broadcast(left.agg(F.count("*").alias("logged"))))  # one row


# ---- vectors

_QUERY = [((k * 37) % 19 - 9) / 10 for k in range(64)]


@_add("vec_1_top_k", "faces_fx", f" SELECT id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QUERY}::DOUBLE[]), 4) AS score FROM faces_fx ORDER BY score DESC, id LIMIT 10")
def _(f):
    return vectors.top_k(f, _QUERY, 10)


@_add("vec_2_top_k_batch", "faces_fx", f", s AS (SELECT b.id AS query_id, a.id, round({_COS}, 9) AS score FROM faces_fx a, faces_fx b WHERE b.id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5")
def _(f):
    found = vectors.top_k_batch(f, f.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), 5)
    return found.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


_CENTRES = "SELECT cluster_id, list(v / n ORDER BY i) AS embedding FROM (SELECT cluster_id, i, v, sqrt(sum(v * v) OVER (PARTITION BY cluster_id)) AS n FROM (SELECT cluster_id, i, avg(CAST(v AS DOUBLE)) AS v FROM (SELECT cluster_id, unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM {0} WHERE cluster_id IS NOT NULL) GROUP BY ALL)) GROUP BY cluster_id"


#: labelled old centres a take new ones b, one after another; {0}: the threshold
_ANCHORED = (
    f"), sims AS (SELECT dense_rank() OVER (ORDER BY a.cluster_id) AS k, a.cluster_id AS old, b.cluster_id AS new, round({_COS}, 9) AS s FROM a, b),"
    " step AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS taken, CAST(NULL AS INTEGER) AS old, CAST(NULL AS INTEGER) AS new UNION ALL SELECT t.k + 1, CASE WHEN p.new IS NULL THEN taken ELSE list_append(taken, p.new) END, o.old, p.new FROM step t JOIN (SELECT DISTINCT k, old FROM sims) o ON o.k = t.k + 1 LEFT JOIN LATERAL (SELECT q.new FROM sims q WHERE q.k = t.k + 1 AND q.s >= {0} AND NOT list_contains(t.taken, q.new) ORDER BY q.s DESC, q.new LIMIT 1) p ON true)"
)


@_add(
    "vec_6_reanchor",
    "faces_fx",
    ", moved AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN cluster_id + 100 ELSE cluster_id + 50 END AS cluster_id) FROM faces_fx), a AS (" + _CENTRES.format("faces_fx") + "), b AS (" + _CENTRES.format("moved") + _ANCHORED.format('0.3e0') +
    " SELECT CAST(new AS BIGINT) AS cluster_id, concat('name ', old) AS label FROM step WHERE new IS NOT NULL",
)
def _(f):
    moved = f.withColumn("cluster_id", F.when(F.col("id") % 3 == 0, F.col("cluster_id") + 100).otherwise(F.col("cluster_id") + 50))
    labels = f.where("cluster_id is not null").select("cluster_id").distinct().withColumn("label", F.concat(F.lit("name "), F.col("cluster_id").cast("string")))
    return vectors.reanchor_labels(labels, vectors.centroids(f), vectors.centroids(moved), 0.3).select(F.col("cluster_id").cast("long").alias("cluster_id"), "label")


_ASSIGN = (
    f", s AS (SELECT a.id AS fresh, b.id AS other, b.cluster_id, round({_COS}, 9) AS s FROM faces_fx a, faces_fx b WHERE a.cluster_id IS NULL AND b.cluster_id IS NOT NULL), joined AS (SELECT fresh AS id, arg_max(CAST(cluster_id AS BIGINT), (s, -other)) AS cluster_id FROM s GROUP BY fresh HAVING max(s) >= 0.8e0), rest AS (SELECT * FROM faces_fx WHERE cluster_id IS NULL AND id NOT IN (SELECT id FROM joined)),"
    f" e AS (SELECT a.id AS x, b.id AS y FROM rest a, rest b WHERE a.id <> b.id AND {_COS} >= 0.8e0), reach AS (SELECT id AS node, id AS seen FROM rest UNION SELECT node, y FROM reach JOIN e ON seen = x), comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node), given AS (SELECT * FROM joined UNION ALL SELECT node, dense_rank() OVER (ORDER BY c) + (SELECT max(cluster_id) FROM faces_fx) FROM comp)"
)


@_add("vec_7_assign_new", "faces_fx", _ASSIGN + " SELECT id, cluster_id FROM given")
def _(f):
    return vectors.assign_new(f, 0.8)


@_add("pipe_4_faces_run", "faces_fx", _ASSIGN + " SELECT f.id, coalesce(CAST(f.cluster_id AS BIGINT), g.cluster_id) AS cluster_id FROM faces_fx f LEFT JOIN given g ON g.id = f.id")
def _(f):
    labels = f.where("false").select("cluster_id", F.lit("").alias("label"))
    return faces_run(f, labels, vectors.ClusterConfig(0.8))[0].select("id", F.col("cluster_id").cast("long").alias("cluster_id"))


@_add(
    "pipe_4_full_run",
    "faces_fx",
    f", e AS (SELECT a.id AS x, b.id AS y FROM faces_fx a JOIN faces_fx b ON a.id <> b.id WHERE {_COS} >= 0.38e0), reach AS (SELECT id AS node, id AS seen FROM faces_fx UNION SELECT node, y FROM reach JOIN e ON seen = x), comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node),"
    " named AS (SELECT node, dense_rank() OVER (ORDER BY c) - 1 AS k FROM comp), moved AS (SELECT f.* REPLACE (n.k AS cluster_id) FROM faces_fx f JOIN named n ON n.node = f.id), a AS ("
    + _CENTRES.format("faces_fx")
    + "), b AS ("
    + _CENTRES.format("moved")
    + _ANCHORED.format("0.38e0")
    + " SELECT CAST(m.cluster_id AS BIGINT) AS cluster_id, count(*) AS faces, min(m.id) AS first, concat('name ', any_value(old)) AS label FROM moved m LEFT JOIN step ON new = m.cluster_id GROUP BY m.cluster_id",
)
def _(f):
    """All faces clustered anew, with the labels that the old clusters hand on."""
    labels = f.where("cluster_id is not null").select("cluster_id").distinct().withColumn("label", F.concat(F.lit("name "), F.col("cluster_id").cast("string")))
    faces, kept = faces_run(f, labels, vectors.ClusterConfig(0.38), full=True)
    per = faces.groupBy("cluster_id").agg(F.count("*").alias("faces"), F.min("id").alias("first"))
    return per.join(kept, "cluster_id", "left").select("cluster_id", "faces", "first", F.coalesce("label", F.lit("name ")).alias("label"))


@_add("vec_8_preview", "faces_fx", f", e AS (SELECT a.id AS x, b.id AS y FROM faces_fx a JOIN faces_fx b ON a.id <> b.id WHERE {_COS} >= 0.5e0), reach AS (SELECT id AS node, id AS seen FROM faces_fx UNION SELECT node, y FROM reach JOIN e ON seen = x) SELECT count(*) AS faces, count(DISTINCT c) AS clusters FROM (SELECT node, min(seen) AS c FROM reach GROUP BY node)")
def _(f):
    return vectors.preview(f, 0.5)


_LABELS = ", lab AS (SELECT DISTINCT cluster_id, concat('name ', cluster_id) AS label FROM faces_fx WHERE cluster_id % 2 = 1)"


def _labels(f: DataFrame) -> DataFrame:
    return f.where("cluster_id % 2 = 1").select("cluster_id").distinct().withColumn("label", F.concat(F.lit("name "), F.col("cluster_id").cast("string")))


def _merges(f: DataFrame) -> DataFrame:
    """Clusters of 3, 7 ... go into the one before, multiples of 4 into themselves."""
    return f.where("cluster_id % 4 IN (0, 3)").select(F.col("cluster_id").alias("from")).distinct().withColumn("into", F.when(F.col("from") % 4 == 3, F.col("from") - 1).otherwise(F.col("from")))


@_add("vec_10_merge_faces", "faces_fx", " SELECT id, CASE WHEN cluster_id % 4 = 3 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id FROM faces_fx")
def _(f):
    return vectors.merge_clusters(f, _labels(f), _merges(f))[0].select("id", "cluster_id")


@_add("vec_10_merge_labels", "faces_fx", _LABELS + " SELECT CASE WHEN cluster_id % 4 = 3 THEN cluster_id - 1 ELSE cluster_id END AS cluster_id, label FROM lab")
def _(f):
    return vectors.merge_clusters(f, _labels(f), _merges(f))[1]


@_add("vec_12_labels", "faces_fx", _LABELS + ", patch AS (SELECT DISTINCT cluster_id, CASE WHEN cluster_id % 3 = 1 THEN 'new' ELSE '' END AS label FROM faces_fx WHERE cluster_id % 3 < 2) SELECT cluster_id, label FROM lab WHERE cluster_id NOT IN (SELECT cluster_id FROM patch) UNION ALL SELECT * FROM patch WHERE label <> ''")
def _(f):
    patch = f.where("cluster_id % 3 < 2").select("cluster_id", F.expr("CASE WHEN cluster_id % 3 = 1 THEN ' new ' ELSE '  ' END").alias("label")).distinct()
    return vectors.apply_labels(_labels(f), patch)


# ---- changes


@_add("mut_2_save_verdicts", "metrics_fx", _DECIDED + " SELECT image_id, CASE WHEN image_id % 4 = 0 AND NOT user_override THEN 'review' ELSE verdict END AS verdict, CASE WHEN image_id % 4 = 0 AND NOT user_override THEN 3 ELSE stars END AS stars, user_override FROM verdicts_fx")
def _(m):
    v = _verdicts(m).select("image_id", "verdict", "stars", "user_override")
    return mutate.save_verdicts(v, m.where("image_id % 4 = 0").select("image_id", F.lit("review").alias("verdict"), F.lit(3).alias("stars")))


@_add("mut_4_undo", "metrics_fx", _DECIDED + " SELECT image_id, verdict, stars, label, user_override FROM verdicts_fx")
def _(m):
    before = _verdicts(m).select("image_id", "verdict", "stars", "label", "user_override")
    changed = mutate.override_verdicts(before, m.where("image_id % 10 = 3").select("image_id", F.lit("keeper").alias("verdict"), F.lit(5).alias("stars")))
    return mutate.restore(changed, before.where("image_id % 10 = 3"))


@_add(
    "mut_5_upsert_metrics",
    "metrics_fx",
    """, top AS (SELECT max(image_id) AS m FROM metrics_fx)
SELECT image_id, CASE WHEN image_id % 5 = 0 THEN 0.25e0 ELSE sharp_score END AS sharp_score, CASE WHEN image_id % 5 = 0 THEN NULL ELSE cast_hue END AS cast_hue,
  CASE WHEN image_id % 5 <> 0 THEN blur_angle_deg WHEN image_id % 10 = 0 THEN 45e0 END AS blur_angle_deg, scene FROM metrics_fx
UNION ALL SELECT image_id + m + 1, 0.25e0, NULL, CASE WHEN (image_id + m + 1) % 10 = 0 THEN 45e0 END, NULL FROM metrics_fx, top WHERE image_id % 5 = 0""",
)
def _(m):
    """Measured again: colour cast and blur angle that are null by now replace old ones; the scene is not supplied and stays."""
    top = m.agg((F.max("image_id") + 1).alias("m"))
    some = m.where("image_id % 5 = 0").select("image_id")
    new = some.union(some.crossJoin(F.broadcast(top)).select(F.col("image_id") + F.col("m")))  # top is one row
    new = new.select("image_id", F.lit(0.25).alias("sharp_score"), F.lit(None).cast("string").alias("cast_hue"), F.expr("CASE WHEN image_id % 10 = 0 THEN 45d END").alias("blur_angle_deg"))
    return mutate.upsert(m.select("image_id", "sharp_score", "cast_hue", "blur_angle_deg", "scene"), new, "image_id")


_LIBS = ", lib AS (SELECT DISTINCT CAST(library_id AS BIGINT) AS id FROM images_fx WHERE library_id % 2 = 1)"


@_add("mut_6_libraries", "images_fx", _LIBS + ", roots AS (SELECT DISTINCT concat('/lib', library_id) AS root_path FROM images_fx WHERE library_id IS NOT NULL), allr AS (SELECT id, concat('/lib', id) AS root_path FROM lib UNION ALL SELECT (SELECT max(id) FROM lib) + row_number() OVER (ORDER BY root_path), root_path FROM roots WHERE root_path NOT IN (SELECT concat('/lib', id) FROM lib)) SELECT id, root_path, CASE WHEN id % 3 = 0 THEN 'objects=2,scene=2' WHEN id <= (SELECT max(id) FROM lib) THEN 'scene=1' ELSE '' END AS runs, CASE WHEN id % 3 = 0 THEN '' ELSE 'faces' END AS pending FROM allr")
def _(i):
    libraries = i.where("library_id % 2 = 1").select(F.col("library_id").cast("long").alias("id")).distinct()
    libraries = libraries.select("id", F.concat(F.lit("/lib"), F.col("id").cast("string")).alias("root_path"), F.create_map(F.lit("scene"), F.lit("1")).alias("models_run"), F.array(F.lit("faces")).alias("models_pending"))
    roots = i.where("library_id is not null").select(F.concat(F.lit("/lib"), F.col("library_id").cast("string")).alias("root_path"))
    known = mutate.ensure_libraries(libraries, roots).withColumn("models_pending", F.coalesce("models_pending", F.array(F.lit("faces"))))
    runs = known.where("id % 3 = 0").select("id", F.create_map(F.lit("scene"), F.lit("2"), F.lit("objects"), F.lit("2")).alias("models_run"), F.array().cast("array<string>").alias("models_pending"))
    done = mutate.merge_model_runs(known, runs)
    text = F.array_join(F.array_sort(F.transform(F.map_entries("models_run"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return done.select("id", "root_path", text.alias("runs"), F.array_join("models_pending", ",").alias("pending"))


@_add("mut_7_delete_library", "images_fx metrics_fx", _DECIDED + ", gone AS (SELECT id FROM images_fx WHERE library_id = 2) SELECT 'images' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM images_fx WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'metrics', count(*), CAST(sum(image_id) AS BIGINT) FROM metrics_fx WHERE image_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'verdicts', count(*), CAST(sum(image_id) AS BIGINT) FROM verdicts_fx WHERE image_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'libraries', count(DISTINCT library_id), CAST(sum(DISTINCT library_id) AS BIGINT) FROM images_fx WHERE library_id <> 2")
def _(i, m):
    libraries = i.where("library_id is not null").select(F.col("library_id").alias("id")).distinct()
    left = mutate.delete_library({"libraries": libraries, "images": i.select("id", "library_id"), "metrics": m.select("image_id"), "verdicts": _verdicts(m).select("image_id")}, 2)
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id" if "id" in df.columns else "image_id").alias("ids")) for name, df in left.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@_add("mut_8_snapshot", "images_fx metrics_fx", _DECIDED + " SELECT id AS image_id, path, size_bytes, scene, stars FROM images_fx i JOIN verdicts_fx v ON v.image_id = id JOIN metrics_fx m ON m.image_id = id WHERE verdict = 'reject'")
def _(i, m):
    saved = mutate.archive_rejects(i, m, _verdicts(m))[0]
    at = lambda c, p: F.get_json_object(c, f"$.{p}").alias(p)
    return saved.select("image_id", at("image", "path"), at("image", "size_bytes").cast("long"), at("metrics", "scene"), at("verdict", "stars").cast("int"))


@_add(
    "mut_9_restore_archive",
    "images_fx metrics_fx",
    _DECIDED
    + """, j AS (SELECT id, i.path, library_id, capture_s, iso, verdict, stars, user_override, v.reasons, sharp_score, cast_hue FROM images_fx i JOIN verdicts_fx v ON v.image_id = id JOIN metrics_fx m ON m.image_id = id)
SELECT CASE WHEN verdict = 'reject' AND id % 2 = 0 THEN id + 1000000 ELSE id END AS id, path, library_id, capture_s, iso, verdict, stars, user_override, reasons, sharp_score, cast_hue FROM j""",
)
def _(i, m):
    """Rejects go into the archive, half of their paths are scanned again under new ids and measured otherwise, and all come back.
    The new ids are beyond all others while the tables are changed, and are named as in the SQL at the end."""
    beyond = 1 << 48
    v = materialize(_verdicts(m), "verdicts")
    saved, rest = mutate.archive_rejects(i, m, v)
    saved = materialize(saved, "archive")
    kept = v.where("verdict <> 'reject'")
    known = lambda df: df.join(kept.select("image_id"), "image_id", "left_semi")
    again = i.join(saved.select(F.col("image_id").alias("id")), "id", "left_semi").where("id % 2 = 0").withColumns({"id": F.col("id") + beyond, "iso": F.lit(77), "capture_s": F.lit(None).cast("long")})
    wrong = m.limit(0).unionByName(again.select(F.col("id").alias("image_id"), F.lit(0.5).alias("sharp_score"), F.lit("grey").alias("cast_hue")), allowMissingColumns=True)
    images, metrics, verdicts = mutate.restore_archive(saved, rest.unionByName(again), known(m).unionByName(wrong), kept)
    j = images.join(verdicts.withColumnRenamed("image_id", "id"), "id").join(metrics.withColumnRenamed("image_id", "id"), "id")
    named = F.when(F.col("id") >= beyond, F.col("id") - beyond + 1_000_000).otherwise(F.col("id")).alias("id")
    return j.select(named, "path", "library_id", "capture_s", "iso", "verdict", "stars", "user_override", "reasons", "sharp_score", "cast_hue")


@_add("mut_10_backfill", "images_fx", f", lib AS (SELECT DISTINCT CAST(library_id AS BIGINT) AS id, concat('/lib', library_id) AS root_path FROM images_fx WHERE library_id IS NOT NULL), made AS (SELECT (SELECT max(id) FROM lib) + row_number() OVER (ORDER BY root_path) AS id, root_path FROM (SELECT DISTINCT {_FOLDER} AS root_path FROM images_fx WHERE library_id IS NULL)) SELECT i.id, coalesce(CAST(i.library_id AS BIGINT), m.id) AS library_id FROM images_fx i LEFT JOIN made m ON m.root_path = {_FOLDER.replace('path', 'i.path', 1)}")
def _(i):
    libraries = i.where("library_id is not null").select(F.col("library_id").cast("long").alias("id")).distinct().withColumn("root_path", F.concat(F.lit("/lib"), F.col("id").cast("string")))
    return mutate.backfill_libraries(i, libraries)[0].select("id", F.col("library_id").cast("long").alias("library_id"))
