"""Views that map the driver's tables onto the photo model, in one template for Spark and DuckDB.

{S} is the string type, {div} whole-number division, {sec} a timestamp's second. All arithmetic is on integers, so both
engines agree on every value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES = {
    "id": "event_id",
    "library_id": "CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id % 5 + 1 AS INT) END",
    "path": "concat('/lib', CAST(user_id % 5 + 1 AS {S}), '/', event_type, '/d', CAST(event_id {div} 500 AS {S}), '/img_', CAST(event_id % 500 AS {S}), CASE event_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.NEF' WHEN 2 THEN '.heic' ELSE '.png' END)",
    "size_bytes": "1000 + event_id * 7919 % 50000",
    "mtime": "CAST({sec} AS DOUBLE)",
    "content_hash": "concat('v2:', md5(concat('c', CAST(event_id AS {S}))))",
    "capture_s": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE ({sec} {div} 3600) * 3600 + event_id % 20 END",
    "camera_make": "CASE event_id % 4 WHEN 0 THEN 'Nikon' WHEN 1 THEN 'Canon' WHEN 2 THEN NULL ELSE 'Sony' END",
    "camera_model": "CASE event_id % 5 WHEN 0 THEN 'Z 6/II' WHEN 1 THEN 'EOS R5' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'A7 IV' END",
    "lens_model": "CASE event_id % 3 WHEN 0 THEN '24-70mm f/2.8' WHEN 1 THEN '85mm f/1.4' ELSE NULL END",
    "iso": "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 100 WHEN 3 THEN 200 WHEN 4 THEN 1600 WHEN 5 THEN 3200 WHEN 6 THEN 6400 ELSE 12800 END",
    "f_number": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 1.8e0 WHEN 2 THEN 2.8e0 WHEN 3 THEN 4e0 WHEN 4 THEN 5.6e0 ELSE 8e0 END",
    "exposure_time": "CASE event_id % 6 WHEN 0 THEN 4e-3 WHEN 1 THEN 1e-2 WHEN 2 THEN 5e-1 WHEN 3 THEN 1e0 WHEN 4 THEN 2e0 ELSE NULL END",
    "focal_length_mm": "CASE event_id % 7 WHEN 0 THEN 12e0 WHEN 1 THEN 24e0 WHEN 2 THEN 50e0 WHEN 3 THEN 85e0 WHEN 4 THEN 200e0 WHEN 5 THEN 400e0 ELSE NULL END",
    "width": "CASE event_id % 4 WHEN 0 THEN 4000 WHEN 1 THEN 3000 WHEN 2 THEN 3000 ELSE NULL END",
    "height": "CASE event_id % 4 WHEN 0 THEN 3000 WHEN 1 THEN 4000 WHEN 2 THEN 2960 ELSE NULL END",
    "gps_lat": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 13 % 180 - 90 AS DOUBLE) END",
    "gps_lon": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id * 17 % 360 - 180 AS DOUBLE) END",
    "phash": "concat(substr(md5(concat('g', CAST({sec} {div} 3600 AS {S}), '-', CAST(event_id % 3 AS {S}))),1,13), substr(md5(CAST(event_id AS {S})),1,3))",
}
METRICS = {
    "image_id": "event_id",
    "sharp_score": "CAST(event_id * 37 % 101 AS DOUBLE) / 100e0",
    "subject_sharp_score": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id * 53 % 101 AS DOUBLE) / 100e0 END",
    "laplacian_var": "CAST(event_id * 29 % 300 AS DOUBLE)",
    "tenengrad": "CAST(event_id * 61 % 2000 AS DOUBLE)",
    "fft_anisotropy": "CAST(event_id * 31 % 100 AS DOUBLE) / 100e0",
    "blur_angle_deg": "CAST(event_id % 18 * 10 AS DOUBLE)",
    "mean_luma": "CAST(event_id * 17 % 256 AS DOUBLE)",
    "dynamic_range": "CAST(event_id * 19 % 256 AS DOUBLE)",
    "clipped_highlight": "CAST(event_id * 7 % 25 AS DOUBLE) / 100e0",
    "clipped_shadow": "CAST(event_id * 11 % 40 AS DOUBLE) / 100e0",
    "faces": "CAST(event_id % 5 AS INT)",
    "closed_count": "CAST(CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id {div} 5 % (event_id % 5 + 1) END AS INT)",
    "any_closed": "(event_id {div} 5 % (event_id % 5 + 1)) > 0",
    "occluded_count": "CAST(CASE WHEN event_id % 7 = 0 THEN event_id {div} 5 % (event_id % 5 + 1) ELSE 0 END AS INT)",
    "min_ear": "CASE WHEN event_id % 13 = 0 OR event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 40 AS DOUBLE) / 100e0 END",
    "max_blink": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 3 % 100 AS DOUBLE) / 100e0 END",
    "max_smile": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id * 5 % 97 AS DOUBLE) / 100e0 END",
    "horizon_tilt_deg": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id * 23 % 200 - 100 AS DOUBLE) / 10e0 END",
    "thirds_offset": "CASE WHEN event_id % 10 = 0 OR event_id % 9 = 0 THEN NULL ELSE CAST(event_id * 41 % 100 AS DOUBLE) / 100e0 END",
    "aesthetic_score": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id * 43 % 101 AS DOUBLE) / 100e0 END",
    "aesthetic_source": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'topiq' WHEN 2 THEN 'topiq' ELSE 'nima' END",
    "face_w": "CAST(100 + event_id * 59 % 900 AS INT)",
    "face_h": "CAST(100 + event_id * 67 % 900 AS INT)",
    "decoded_long": "2000",
    "focus_on_background": "event_id % 17 = 0",
    "cast_strength": "CAST(event_id * 71 % 60 AS DOUBLE) / 100e0",
    "cast_hue": "CASE event_id % 4 WHEN 0 THEN 'red' WHEN 1 THEN 'green' WHEN 2 THEN 'blue' ELSE NULL END",
    "temperature": "CASE event_id % 3 WHEN 0 THEN 'warm' WHEN 1 THEN 'cool' ELSE 'neutral' END",
    "saturation": "CASE event_id % 4 WHEN 0 THEN 'mono' WHEN 1 THEN 'muted' ELSE 'vivid' END",
    "dom_r": "CAST(event_id * 73 % 256 AS INT)",
    "dom_g": "CAST(event_id * 79 % 256 AS INT)",
    "dom_b": "CAST(event_id * 83 % 256 AS INT)",
    "scene": "CASE event_id % 6 WHEN 0 THEN 'beach' WHEN 1 THEN 'office' WHEN 2 THEN 'forest path' ELSE NULL END",
    "content_type": "CASE event_id % 5 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'document' WHEN 2 THEN 'photo' ELSE NULL END",
}
FACES = {
    "id": "vec_id",
    "image_id": "vec_id % 200",
    "embedding": "embedding",
    "cluster_id": "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE label END",
    "quality": "CASE WHEN vec_id % 19 = 0 THEN NULL ELSE CAST(vec_id * 37 % 101 AS DOUBLE) / 100e0 END",
}

PROPS = {"id": "event_id", "props": "props"}
PLACES = {"country": "concat('country ', CAST(c_nationkey AS {S}))", "region": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('region ', CAST(c_custkey % 7 AS {S})) END", "city": "concat('city ', CAST(c_custkey AS {S}))", "lat": "CAST(c_custkey * 37 % 170 - 85 AS DOUBLE)", "lon": "CAST(c_custkey * 101 % 360 - 180 AS DOUBLE)"}

SPARK = {"S": "STRING", "div": "div", "sec": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"}
DUCKDB = {"S": "VARCHAR", "div": "//", "sec": "(epoch_us(ts) // 1000000)"}
#: view -> (table, columns)
VIEWS = {"images_fx": ("events", IMAGES), "metrics_fx": ("events", METRICS), "faces_fx": ("embeddings", FACES), "props_fx": ("events", PROPS), "places_fx": ("customer", PLACES)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in columns.items()])


def duckdb_with(*names: str) -> str:
    """WITH clause that defines the views; more CTEs may follow."""
    ctes = [f"{n} AS (SELECT {', '.join(f'{e.format(**DUCKDB)} AS {c}' for c, e in VIEWS[n][1].items())} FROM {VIEWS[n][0]})" for n in names]
    return "WITH RECURSIVE " + ", ".join(ctes)
