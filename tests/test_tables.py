"""Merge-on-read tables, ranged reads and nested measures."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lumenlake.operators.decide import decide
from lumenlake.sources import files, metrics, tables
from lumenlake.sources.tables import Catalog, Change

ROWS = "image_id long, verdict string, stars int"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(df):
    return sorted(map(tuple, df.collect()))


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_changes_and_versions(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    first = c.save("verdicts", rows(spark, (1, "keeper", 5), (2, "reject", 0), (3, "review", 2)))
    c.commit({"verdicts": Change(rows(spark, (2, "keeper", 4), (9, "review", 3)), rows(spark, (1, None, None)))})
    c.commit({"verdicts": Change(rows(spark, (1, "reject", None)))})
    assert content(c.load("verdicts")) == [(1, "reject", None), (2, "keeper", 4), (3, "review", 2), (9, "review", 3)]
    assert content(c.load("verdicts", version=first)) == [(1, "keeper", 5), (2, "reject", 0), (3, "review", 2)]
    assert content(c.find("verdicts", rows(spark, (9, "", 0), (77, "", 0)))) == [(9, "review", 3)]
    assert c.load("metrics", ROWS).isEmpty() and c.find("metrics", rows(spark, (1, "", 0)), ROWS).isEmpty()
    with pytest.raises(ValueError, match="no table"):
        c.load("metrics")
    assert content(c.load("verdicts", "image_id long, note string"))[0] == (1, None)


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.save("verdicts", spark.range(200_000).select(F.col("id").alias("image_id"), F.md5(F.col("id").cast("string")).alias("verdict"), F.lit(1).alias("stars")))
    whole = size(tmp_path)
    c.commit({"verdicts": Change(spark.range(1000).select((F.col("id") * 7).alias("image_id"), F.lit("again").alias("verdict"), F.lit(2).alias("stars")))})
    assert size(tmp_path) - whole < whole / 50
    assert c.load("verdicts").where("stars = 2").count() == 1000 and c.load("verdicts").count() == 200_000


def test_many_batches_are_merged(spark, tmp_path):
    c, want = Catalog(spark, str(tmp_path)), {}
    c.save("verdicts", rows(spark, *[(i, "new", 0) for i in range(200)]))
    want = {i: "new" for i in range(200)}
    for n in range(tables.CHANGES + 3):
        c.commit({"verdicts": Change(rows(spark, (n, f"b{n}", n), (500 + n % 3, f"b{n}", n)), rows(spark, (199 - n, "", 0)))})
        want |= {n: f"b{n}", 500 + n % 3: f"b{n}"}
        want.pop(199 - n)
    held = c._manifest()["tables"]["verdicts"]
    assert len(held["changes"]) <= tables.CHANGES
    assert {r.image_id: r.verdict for r in c.load("verdicts").collect()} == want
    assert c.vacuum() > 0 and {r.image_id: r.verdict for r in c.load("verdicts").collect()} == want


def test_a_run_that_ends_between_two_tables_changes_none(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path))
    more = [(i, "more", i) for i in range(2, 9)]
    c.save_all({"verdicts": rows(spark, (1, "keeper", 5), *more), "metrics": rows(spark, (1, "m", 1), *more)})
    write, seen = Catalog._write, []

    def failing(self, name, df, by):
        seen.append(name)
        if len(seen) == 2:
            raise OSError("killed")
        return write(self, name, df, by)

    monkeypatch.setattr(Catalog, "_write", failing)
    with pytest.raises(OSError):
        c.commit({"verdicts": Change(rows(spark, (1, "reject", 0))), "metrics": Change(rows(spark, (1, "n", 2)))})
    monkeypatch.undo()
    assert seen == ["verdicts", "metrics"]
    assert content(c.load("verdicts"))[0] == (1, "keeper", 5) and content(c.load("metrics"))[0] == (1, "m", 1)
    c.commit({"verdicts": Change(rows(spark, (1, "reject", 0))), "metrics": Change(rows(spark, (1, "n", 2)))})
    assert content(c.load("verdicts")) == [(1, "reject", 0), *more] and content(c.load("metrics")) == [(1, "n", 2), *more]
    assert c.vacuum(1) == 1 and content(c.load("metrics")) == [(1, "n", 2), *more]  # what the killed run left


def test_images_are_parted_by_library(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.save("images", spark.createDataFrame([(1, "/a", 4), (2, "/b", None)], "id long, path string, library_id long"))
    c.commit({"images": Change(spark.createDataFrame([(2, "/c", 5)], "id long, path string, library_id long"))})
    assert content(c.load("images").select("id", "path", "library_id")) == [(1, "/a", 4), (2, "/c", 5)]


def test_keys_by_the_ends_of_files(spark, tmp_path):
    edge = files.EDGE
    bodies = {"a.jpg": b"", "b.jpg": b"abc", "c.NEF": os.urandom(edge), "d d.png": os.urandom(edge + 1), "e.jpg": os.urandom(2 * edge), "f.jpg": os.urandom(2 * edge + 77), "g.jpg": os.urandom(5_000_000)}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    listed = files.scan_files(spark, str(tmp_path)).select("path")  # Spark lists no empty files
    got = {os.path.basename(r.path): r for r in files.content_keys(listed.union(spark.createDataFrame([(f"{tmp_path}/a.jpg",)], "path string"))).collect()}
    for name, b in bodies.items():
        tail = b[max(len(b) - edge, edge) :] if len(b) > edge else b""
        assert got[name].content_hash == "v2:" + hashlib.sha1(str(len(b)).encode() + b[:edge] + tail).hexdigest()
        assert got[name].bytes_read == min(len(b), 2 * edge)
    gone = files.content_keys(spark.createDataFrame([("/nowhere/x.jpg",)], "path string")).first()
    assert (gone.content_hash, gone.bytes_read) == (None, None)


def test_nested_measures(spark):
    texts = [
        '{"sharpness": {"score": 0.9, "laplacian_var": 200, "fft_anisotropy": 0.1}, "subject_sharpness": {"score": 0.5, "laplacian_var": 25}, "subjects": [{"kind": "face", "bbox": [0, 0, 300, 900]}, {"kind": "face", "bbox": [5, 5, 400, 100]}, {"kind": "saliency", "bbox": [0, 0, 2000, 2000]}], "decoded_size": [2000, 1300], "eyes": {"faces": 2, "ears": [0.1, 0.3], "blinks": [[0.1, 0.2], [0.3, 0.1]]}, "exposure": {"mean_luma": 128, "dynamic_range": 200}}',
        '{"sharpness": {"score": 0.9}, "subject_sharpness": {}, "exposure": {"mean_luma": 250, "overexposed": false}, "color": {"cast_hue": "red", "cast_strength": 0.3, "dominant": [[1, 2, 3]]}, "animals": [{"species": "cat"}]}',
        "{}",
        "no json",
        None,
        '{"sharpness": {"score": 0.9}, "eyes": {"faces": 1, "any_closed": true}, "subjects": [{"kind": "face"}], "decoded_size": [100]}',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "image_id long, metrics_json string")
    wide = {r.image_id: r for r in metrics.flat(metrics.parsed(df)).collect()}
    a = wide[0]
    assert (a.face_w, a.face_h, a.decoded_long, a.faces, a.face_subject) == (400, 100, 2000, 2, True)
    assert (a.sharp_score, a.subject_sharp_score, a.laplacian_var, a.fft_anisotropy) == (0.9, 0.5, 25.0, None)
    assert (a.closed_count, a.any_closed, a.min_ear, a.max_blink) == (1, True, 0.1, 0.3)
    assert (wide[1].subject_sharp_score, wide[1].overexposed, wide[1].dom_g, wide[1].animals) == (None, False, 2, ["cat"])
    assert all(wide[i].faces == 0 and wide[i].sharp_score is None for i in (2, 3, 4))
    assert (wide[5].face_subject, wide[5].face_w, wide[5].decoded_long, wide[5].closed_count) == (True, None, None, None)
    got = {r.image_id: r for r in decide(metrics.flat(metrics.parsed(df))).collect()}
    assert got[0].verdict == "reject" and got[0].reasons[0] == "out of focus"  # the wide face is soft: 25 < 50 * 0.2 / 0.35
    assert got[1].verdict == "keeper" and got[1].warnings == ["red colour cast"]
    assert got[2].verdict == "reject" and got[5].reasons == ["eyes closed"]
