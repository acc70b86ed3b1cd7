"""Ingest, sync and faces, end to end on a small folder."""

import os

import numpy as np

from lumenlake.plans import pipelines
from lumenlake.operators.vectors import ClusterConfig
from lumenlake.sources.files import Catalog
from tests.test_sources_and_streams import png


def test_ingest_and_sync(spark, tmp_path):
    rng = np.random.default_rng(1)
    root = tmp_path / "pics"
    root.mkdir()
    for i in range(4):
        (root / f"{i}.png").write_bytes(png(rng.integers(0, 256, (40, 48, 3), dtype=np.uint8)))
    (root / "x.nef").write_bytes(b"raw")
    catalog = Catalog(spark, str(tmp_path / "cat"))
    pipelines.ingest_folders(spark, catalog, [f" {root} ", str(root) + "/"])
    images = {os.path.basename(r.path): r for r in catalog.load("images", pipelines.IMAGES).collect()}
    assert sorted(images) == ["0.png", "1.png", "2.png", "3.png"] and len({r.id for r in images.values()}) == 4
    assert catalog.load("libraries", pipelines.LIBRARIES).count() == 1
    assert catalog.load("verdicts", pipelines.VERDICTS).count() == catalog.load("metrics", pipelines.METRICS).count() == 4
    assert [r.error for r in catalog.load("errors", pipelines.ERRORS).collect()] == ["not decoded"]

    library = catalog.load("libraries", pipelines.LIBRARIES).first()
    assert library.models_run == pipelines.MODELS and library.models_pending == []
    id_of = lambda n: images[n].id
    catalog.save("members", spark.createDataFrame([(1, id_of("0.png"), True), (1, id_of("2.png"), False), (2, id_of("2.png"), True)], pipelines.MEMBERS))
    catalog.save("bursts", spark.createDataFrame([(1,), (2,)], pipelines.BURSTS))

    os.rename(root / "1.png", root / "moved.png")
    os.remove(root / "2.png")
    (root / "new.png").write_bytes(png(rng.integers(0, 256, (40, 48, 3), dtype=np.uint8)))
    report = {r.id: r.status for r in pipelines.sync_library(spark, catalog, str(root)).collect()}
    assert report == {images["0.png"].id: "kept", images["1.png"].id: "rehoused", images["2.png"].id: "removed", images["3.png"].id: "kept"}
    after = {os.path.basename(r.path): r.id for r in catalog.load("images", pipelines.IMAGES).collect()}
    assert sorted(after) == ["0.png", "3.png", "moved.png", "new.png"] and after["moved.png"] == images["1.png"].id
    assert {r.image_id for r in catalog.load("verdicts", pipelines.VERDICTS).collect()} == set(after.values())
    assert [r.burst_id for r in catalog.load("bursts", pipelines.BURSTS).collect()] == [1] and catalog.load("members", pipelines.MEMBERS).count() == 1


def test_sync_by_size_time_and_camera(spark, tmp_path):
    from pyspark.sql import functions as F

    root = tmp_path / "pics"
    root.mkdir()
    (root / "a.nef").write_bytes(b"first content")
    catalog = Catalog(spark, str(tmp_path / "cat"))
    catalog.save("libraries", spark.createDataFrame([(1, str(root), None, None)], pipelines.LIBRARIES))
    row = {"id": 7, "path": f"{root}/old.nef", "size_bytes": 13, "content_hash": "v2:other", "capture_s": 100, "camera_model": "Z", "library_id": 1}
    catalog.save("images", spark.createDataFrame([row], pipelines.IMAGES))
    captured = spark.createDataFrame([(f"{root}/a.nef", 100, "Z")], "path string, capture_s long, camera_model string")
    report = pipelines.sync_library(spark, catalog, str(root), captured=captured)
    assert [(r.id, os.path.basename(r.path), r.status) for r in report.collect()] == [(7, "a.nef", "rehoused")]
    assert catalog.load("images", pipelines.IMAGES).where(F.col("id") == 7).first().path == f"{root}/a.nef"


def test_faces_run(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(16)[:3]
    rows = [(i, (centres[i % 3] + rng.normal(0, 0.02, 16)).tolist(), None) for i in range(18)]
    faces = spark.createDataFrame(rows, "id long, embedding array<double>, cluster_id long")
    labels = spark.createDataFrame([], "cluster_id long, label string")
    first, _ = pipelines.faces_run(faces, labels, ClusterConfig(0.5))
    first = {r.id: r.cluster_id for r in first.collect()}
    assert len(set(first.values())) == 3 and all(first[i] == first[i % 3] for i in range(18))
    known = spark.createDataFrame([(i, e, first[i]) for i, e, _ in rows], "id long, embedding array<double>, cluster_id long")
    named = spark.createDataFrame([(first[1], "Ann")], "cluster_id long, label string")
    again, kept = pipelines.faces_run(known, named, ClusterConfig(0.5), full=True)
    of = {r.id: r.cluster_id for r in again.collect()}
    assert [(r.cluster_id, r.label) for r in kept.collect()] == [(of[1], "Ann")]
