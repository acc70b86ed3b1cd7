"""Files, pictures, detections, SQL functions and streams."""

import datetime as dt
import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.functions import detections as D
from lumenlake.functions import sql
from lumenlake.operators import pixels
from lumenlake.sources import files
from lumenlake.streaming import live


def png(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("photos")
    rng = np.random.default_rng(3)
    noisy = rng.integers(0, 256, (48, 64, 3), dtype=np.uint8)
    flat = np.full((40, 40, 3), (255, 0, 0), np.uint8)
    for name, body in {"a.PNG": png(noisy), "sub/b.png": png(flat), "c.txt": b"x", "p.photoslibrary/originals/d.jpg": b"j" * 70000, "p.photoslibrary/other/e.jpg": b"k"}.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_bytes(body)
    return str(root), noisy, flat


def test_files(spark, folder):
    root, _, _ = folder
    got = {os.path.relpath(r.path, root): r for r in files.scan_files(spark, root).collect()}
    assert set(got) == {"a.PNG", "sub/b.png", "p.photoslibrary/originals/d.jpg"}
    assert got["a.PNG"].kind == "other" and got["p.photoslibrary/originals/d.jpg"].kind == "jpeg"


def test_content_key(spark):
    def key(b):
        tail = b[max(len(b) - 65536, 65536) :] if len(b) > 65536 else b""
        return "v2:" + hashlib.sha1(str(len(b)).encode() + b[:65536] + tail).hexdigest()

    bodies = [b"", b"abc", os.urandom(65536), os.urandom(65537), os.urandom(100000), os.urandom(200000)]
    rows = spark.createDataFrame([(bytearray(b),) for b in bodies], "content binary")
    got = rows.select(files.content_key("content", F.length("content")).alias("k")).collect()
    assert sorted(r.k for r in got) == sorted(map(key, bodies))


def test_pixels(spark, folder):
    root, noisy, flat = folder
    rows = pixels.derived(pixels.image_metrics(files.read_images(spark, root))).collect()
    got = {os.path.basename(r.path): r for r in rows}
    a, b = got["a.PNG"], got["b.png"]
    assert a.error is None and (a.width, a.height) == (64, 48)
    assert abs(a.mean_luma - pixels.grey_of(noisy).mean()) < 1e-9 and abs(a.mean_r - noisy[:, :, 0].mean()) < 1e-9
    assert (b.laplacian_var, b.tenengrad, b.noise_sigma, b.dynamic_range, b.colours) == (0, 0, 0, 0, 1)
    assert [(d.r, d.g, d.b, d.weight) for d in b.dominant] == [(255, 0, 0, 1.0)]
    assert b.cast_hue == "red" and b.temperature == "warm" and b.saturation == "vivid" and a.sharp_score > b.sharp_score == 0
    assert len(a.phash) == len(a.dhash) == 16
    bad = spark.createDataFrame([("x", 4, 4, 3, bytearray(b"12"))], "path string, width int, height int, channels int, data binary")
    assert pixels.image_metrics(bad).first().error is not None


def test_pixel_rules():
    y, x = np.mgrid[:64, :64]
    waves = (127 + 120 * np.sin(x / 3)).astype(np.uint8)
    share, angle = pixels.anisotropy(waves)
    assert share > 0.45 and min(abs(angle - 95), abs(angle - 85)) < 1e-9
    assert pixels.anisotropy(waves[:20]) == (0.0, None) and pixels.noise_sigma(waves[:2]) == 0
    small = pixels.resize(np.arange(16.0).reshape(4, 4), 2, 2)
    assert np.allclose(small, [[2.5, 4.5], [10.5, 12.5]])
    assert np.isclose(pixels.resize(waves, 9, 7).mean(), waves.mean())
    up = pixels.dhash(np.tile(np.arange(90, dtype=np.uint8), (80, 1)))
    assert up == "f" * 16


BOX = "struct<x0:int,y0:int,x1:int,y1:int>"


def test_primary_subjects(spark):
    face = lambda x, y, w, h: ("face", float(x), float(y), float(w), float(h))
    cases = [
        ([face(0, 0, 100, 100)], None, None, 1),
        ([face(0, 0, 5, 5)], None, None, 0),  # a speck
        ([face(i * 100, 0, 90, 90) for i in range(4)], None, None, 0),  # a crowd
        ([face(i * 100, 0, 90, 90) for i in range(4)], (95, 0, 195, 100), None, 1),  # one of a crowd in front
        ([face(i * 100, 0, 90, 90) for i in range(4)], (0, 0, 1000, 900), None, 0),  # a loose region promotes none
        ([face(0, 0, 200, 200), face(300, 0, 190, 190), face(600, 0, 50, 50)], None, None, 2),
        ([], (0, 0, 900, 900), [(0, 0, 10, 10)], 1),
        ([("saliency", 1.0, 1.0, 9.0, 9.0)], None, None, 1),
        (None, None, None, 0),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, s {D.SUBJECTS}, salient {BOX}, persons array<{BOX}>, n int")
    got = df.select("i", "n", D.primary_subjects("s", "salient", "persons", F.lit(1000), F.lit(1000)).alias("p")).collect()
    assert [len(r.p) for r in got] == [r.n for r in got]
    by = {r.i: r.p for r in got}
    assert by[3][0].x == 100 and by[5][0].w == 200 and (by[6][0].kind, by[6][0].w) == ("saliency", 900)


def test_detections_of_nulls(spark):
    df = spark.createDataFrame([(None, None)], "a array<struct<species:string,confidence:double>>, o array<struct<kind:string,confidence:double>>")
    assert df.select(D.merge_animals("a", "o").alias("m")).first().m == []
    faces = "array<struct<left_ear:double,right_ear:double,left_blink:double,right_blink:double,smile:double,frown:double,occluded:boolean>>"
    e = spark.createDataFrame([(None,)], f"f {faces}").select(D.eye_report("f").alias("e")).first().e
    assert (e.faces, e.closed_count, e.any_closed, e.min_ear) == (0, 0, False, None)
    c = spark.createDataFrame([(True, None, None)], f"cam boolean, doc double, boxes array<{BOX}>").select(D.content_type("cam", "doc", "boxes", F.lit(999), F.lit(10), F.lit(10), fast=True).alias("c")).first().c
    assert (c.kind, c.conf, c.confident) == ("photo", 0.95, False)


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT hamming64('ff', '0f') h, cosine(array(1D, 0D), array(1D, 1D)) c, safe_name(' a b/ü ') s, safe_name('') e").first()
    assert r.h == 4 and abs(r.c - 0.5**0.5) < 1e-12 and (r.s, r.e) == ("a_b_ü", "_unknown")


def test_catalog_versions(spark, tmp_path):
    c = files.Catalog(spark, str(tmp_path))
    assert c.load("images", "id long, library_id int").count() == 0
    c.save("images", spark.createDataFrame([(1, 1)], "id long, library_id int"))
    c.save("images", c.load("images").unionByName(spark.createDataFrame([(2, None)], "id long, library_id int")))
    assert sorted(r.id for r in c.load("images").collect()) == [1, 2] and c.load("images", version=1).count() == 1
    text = spark.createDataFrame([(1, '{"a": 2.5}'), (2, "{")], "id long, metrics_json string")
    assert [r.a for r in files.parse_metrics(text, "a double").orderBy("id").collect()] == [2.5, None]


def test_live_ingest(spark, tmp_path):
    from lumenlake.sources.fixtures import METRICS, SPARK

    source = tmp_path / "in"
    rows = spark.range(40).withColumnRenamed("id", "event_id").selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in METRICS.items()]).withColumn("mtime", F.lit(1.0))
    rows.coalesce(1).write.parquet(str(source))
    catalog = files.Catalog(spark, str(tmp_path / "cat"))
    run = lambda: live.ingest(spark.readStream.schema(rows.schema).parquet(str(source)), catalog, str(tmp_path / "cp")).awaitTermination()
    run()
    assert catalog.load("metrics").count() == catalog.load("verdicts").count() == 40
    before = {r.image_id: r.verdict for r in catalog.load("verdicts").collect()}
    changed = rows.where("image_id < 5").withColumn("sharp_score", F.lit(0.0)).withColumn("subject_sharp_score", F.lit(0.0)).withColumn("mtime", F.lit(2.0))
    changed.coalesce(1).write.mode("append").parquet(str(source))
    run()
    after = {r.image_id: r.verdict for r in catalog.load("verdicts").collect()}
    assert len(after) == 40 and all(after[i] == "reject" for i in range(5)) and all(after[i] == before[i] for i in range(5, 40))


def test_live_ingest_measured_again_as_null(spark, tmp_path):
    """A colour cast and a blur angle that a later measure does not find are gone from metrics and from the verdict's texts."""
    from lumenlake.sources.fixtures import METRICS, SPARK

    rows = spark.range(1).withColumnRenamed("id", "event_id").selectExpr(*[f"{e.format(**SPARK)} AS {c}" for c, e in METRICS.items()])
    bad = {"sharp_score": 0.1, "subject_sharp_score": 0.1, "fft_anisotropy": 0.9, "blur_angle_deg": 30.0, "cast_hue": "red", "cast_strength": 0.5, "mtime": 1.0}
    first = rows.withColumns({c: F.lit(v) for c, v in bad.items()})
    catalog = files.Catalog(spark, str(tmp_path / "cat"))

    def run(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.ingest(spark.readStream.schema(first.schema).parquet(str(tmp_path / "in")), catalog, str(tmp_path / "cp")).awaitTermination()
        return catalog.load("metrics").first(), catalog.load("verdicts").first()

    m, v = run(first)
    assert (m.cast_hue, m.blur_angle_deg) == ("red", 30.0) and v.reasons[0] == "motion blur (~30°)" and "red colour cast" in v.warnings
    m, v = run(first.withColumns({"cast_hue": F.lit(None).cast("string"), "blur_angle_deg": F.lit(None).cast("double"), "mtime": F.lit(2.0)}))
    assert (m.cast_hue, m.blur_angle_deg) == (None, None) and v.reasons[0] == "motion blur" and not any("cast" in w for w in v.warnings)


def test_live_events(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    times = [("u", day), ("u", day + dt.timedelta(hours=6)), ("u", day + dt.timedelta(hours=12, seconds=1)), ("v", day), ("w", day + dt.timedelta(days=9))]
    rows = spark.createDataFrame(times, "k string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live.live_events(stream, "k").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]
