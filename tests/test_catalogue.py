"""Cases of the blueprint: decisions, bursts, events, filters, changes."""

import random

from pyspark.sql import functions as F

from lumenlake.functions import tokens as T
from lumenlake.functions import values as V
from lumenlake.graph import components
from lumenlake.operators import bursts, catalogue, decide, events, mutate, pairs, reconcile, vectors

METRICS = "image_id long, sharp_score double, subject_sharp_score double, laplacian_var double, fft_anisotropy double, blur_angle_deg double, mean_luma double, dynamic_range double, clipped_highlight double, clipped_shadow double, faces int, closed_count int, any_closed boolean, occluded_count int, min_ear double, max_blink double, max_smile double, horizon_tilt_deg double, thirds_offset double, aesthetic_score double, aesthetic_source string, face_w int, face_h int, decoded_long int, focus_on_background boolean, cast_strength double, cast_hue string"
BASE = dict(sharp_score=0.85, laplacian_var=400.0, fft_anisotropy=0.1, mean_luma=128.0, dynamic_range=180.0, clipped_highlight=0.0, clipped_shadow=0.0, faces=0, any_closed=False, occluded_count=0, horizon_tilt_deg=0.2, thirds_offset=0.1, focus_on_background=False)


def frame(spark, *changes):
    names = [c.split()[0] for c in METRICS.split(", ")]
    rows = [{**dict.fromkeys(names), **BASE, "image_id": i, **c} for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], METRICS)


def test_decisions(spark):
    df = frame(
        spark, {}, {"aesthetic_score": 0.9}, {"faces": 1}, {"faces": 4, "any_closed": True, "closed_count": 1, "min_ear": 0.1}, {"faces": 1, "any_closed": True, "closed_count": 1},
        {"focus_on_background": True}, {"horizon_tilt_deg": 7.0}, {"sharp_score": 0.05, "laplacian_var": 5.0}, {"faces": 1, "any_closed": True, "closed_count": 1, "occluded_count": 1}, {"faces": 1, "any_closed": True},
    )
    r = {x.image_id: x for x in decide.decide(df).collect()}
    assert r[0].verdict == "keeper" and r[0].stars >= 3 and r[0].score >= 0.7
    assert r[1].verdict == "keeper"
    assert abs(r[2].score - r[0].score) < 1e-6
    assert r[3].verdict != "reject" and any("blinking" in w for w in r[3].warnings)
    assert [r[i].verdict for i in (4, 5, 7, 8, 9)] == ["reject", "reject", "reject", "keeper", "reject"]
    assert r[6].verdict == "keeper" and not r[6].reasons and "horizon tilt +7.0°" in r[6].warnings
    assert r[7].stars == 0
    open_ = decide.decide(df, decide.Thresholds(accept_focus_on_background=True)).where("image_id = 5").first()
    assert open_.verdict == "keeper"


def test_tokens_on_nulls(spark):
    names = "capture_s long, camera_make string, camera_model string, lens_model string, focal_length_mm double, width int, height int, iso int, flash_fired boolean, verdict string, stars int, gps_lat double, gps_lon double, city string, event_label string, scene string, object_class string, content_type string, temperature string, saturation string"
    row = spark.createDataFrame([(None,) * 20], names).select(*[T.token(n).alias(f"t{i}") for i, n in enumerate(T.list_tokens())]).first()
    assert all(v in (T.UNKNOWN, T.UNDATED) for v in row) and len(row) == 23


def brute_pairs(rows, near):
    return {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)}


def test_pairs_and_bursts_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        h = rnd.choice([0x1234567890ABCDEF, 0xFFFF0000FFFF0000, 0]) ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(7)))
        rows.append((i, rnd.choice([None, 1, 2]), rnd.choice([None, *range(100, 140)]), f"{h:016x}"))
    df = spark.createDataFrame(rows, "id long, library_id int, capture_s long, phash string")
    near = lambda a, b: bin(int(a[3], 16) ^ int(b[3], 16)).count("1") <= 10
    heads = {r[3]: r for r in sorted(rows, reverse=True)}
    assert {(r.a, r.b) for r in pairs.pair_list(df).collect()} == brute_pairs(list(heads.values()), near)
    assert {(r.id, r.head) for r in pairs.hash_classes(df).collect()} == {(r[0], heads[r[3]][0]) for r in rows}

    def close(a, b):
        return a[1] == b[1] and near(a, b) and (a[2] is None and b[2] is None or None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 3)

    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows, close):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {i: find(i) for i in parent if sum(find(j) == find(i) for j in parent) > 1}
    got = {r.node: r.component for r in components(pairs.burst_pairs(df)).collect()}
    assert got == want


def test_event_gap_of_exactly_the_limit(spark):
    rnd = random.Random(3)
    times, t = [], 0
    for _ in range(200):
        t += rnd.choice([1, 50, 100, 100, 101, 230])
        times.append(t)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(times)] + [(999, None)], "id long, capture_s long")
    ev, members = events.split_events(df, 100)
    want = sum(b - a > 100 for a, b in zip(times, times[1:])) + 1
    assert ev.count() == want and members.count() == 200


def test_filters_and_paging(spark):
    df = spark.createDataFrame([(1, "/a/B.jpg", 5, [[255, 0, 0]], ["slightly soft"], []), (2, "/a/c.jpg", None, [[0, 0, 255]], [], ["horizon tilt +7.0°"])], "id long, path string, capture_s long, dominant array<array<int>>, reasons array<string>, warnings array<string>")
    ids = lambda **k: [r.id for r in catalogue.filter_images(df, catalogue.Filters(**k)).collect()]
    assert ids(reason_blur=True) == [1] and ids(reason_tilt=True) == [2] and ids(hue_anchors=(240.0,)) == [2] and ids(path_contains="b.J") == [1]
    assert [r.id for r in catalogue.page(df, 1, 1).collect()] == [2]


def test_changes(spark):
    lib = spark.createDataFrame([(1, "/a", {"scene": "t1"}, ["x"])], "id long, root_path string, models_run map<string,string>, models_pending array<string>")
    out = mutate.ensure_libraries(lib, spark.createDataFrame([("/a",), ("/b",)], "root_path string"))
    assert {(r.id, r.root_path) for r in out.collect()} == {(1, "/a"), (2, "/b")}
    run = spark.createDataFrame([(1, {"objects": "t2"}, [])], "id long, models_run map<string,string>, models_pending array<string>")
    row = mutate.merge_model_runs(lib, run).first()
    assert row.models_run == {"scene": "t1", "objects": "t2"} and row.models_pending == []


def test_organise_and_undo(spark):
    img = spark.createDataFrame([(1, "/x/a.jpg", "keeper"), (2, "/y/a.jpg", "keeper"), (3, "/y/b.jpg", "reject")], "id long, path string, verdict string")
    plan = reconcile.organize_plan(img, "/out", ["quality:verdict"])
    moved, ops = reconcile.apply_plan(img, plan, "move", "r1")
    assert moved.select("path").distinct().count() == 3 and ops.count() == 3
    back, left = reconcile.undo_last(moved, ops)
    assert {r.path for r in back.collect()} == {"/x/a.jpg", "/y/a.jpg", "/y/b.jpg"} and left.count() == 0


def test_undo_tells_images_at_one_target_apart(spark):
    """Short marks may be equal, so that two images have one target."""
    img = spark.createDataFrame([(1, "/x/a.jpg"), (2, "/y/a.jpg"), (3, "/z/a.jpg")], "id long, path string")
    plan = img.select("id", F.col("path").alias("source"), F.lit("/out/a__123456.jpg").alias("target"))
    moved, ops = reconcile.apply_plan(img, plan, "move", "r1")
    back, left = reconcile.undo_last(moved.withColumn("path", F.when(F.col("id") == 3, "/elsewhere.jpg").otherwise(F.col("path"))), ops)
    assert sorted((r.id, r.path) for r in back.collect()) == [(1, "/x/a.jpg"), (2, "/y/a.jpg"), (3, "/elsewhere.jpg")] and left.isEmpty()


def test_faces(spark):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 1) for _ in range(32)] for _ in range(3)]
    rows = [(c * 8 + i, [x + rnd.gauss(0, 0.02) for x in centres[c]], None) for c in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>, cluster_id int")
    assert vectors.preview(df, 0.8).first() == (24, 3)
    assert {r.src // 8 == r.dst // 8 for r in vectors.cosine_pairs(df, 0.8, block=10).collect()} == {True}
    assert vectors.cosine_pairs(df, 0.8, block=10).count() == 3 * 28


def test_duplicate_groups_short_hashes(spark):
    df = spark.createDataFrame([(1, 1, "ffffff"), (2, 2, "fffff0"), (3, 2, None)], "id long, library_id int, phash string")
    assert {r.image_id for r in bursts.duplicate_groups(df).collect()} == {1, 2}


def test_values(spark):
    row = spark.range(1).select(V.exif_time(F.lit("2024:01:02 03:04:05")).cast("string").alias("t"), V.dms(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("S")).alias("d"), T.exposure_text(F.lit(0.004)).alias("e")).first()
    assert row.t == "2024-01-02 03:04:05" and row.d == -10.5 and row.e == "1/250"


def test_reconcile_copies_of_one_content(spark):
    names = "path string, content_hash string, size_bytes long, capture_s long, camera_model string"
    old = [(i, f"/old/{h}{i}", h, 5, None, None) for i, h in enumerate(["a"] * 3 + ["b"] * 3 + ["c"] * 2 + [None])]
    new = [(f"/new/{h}{k}", h, 5, None, None) for h, n in (("a", 3), ("b", 2), ("c", 3), ("d", 1)) for k in range(n)] + [("/new/none", None, 5, None, None)]
    got = {r.id: (r.path, r.status) for r in reconcile.reconcile(spark.createDataFrame(new, names), spark.createDataFrame(old, "id long, " + names)).collect()}
    moved = {0: "a0", 1: "a1", 2: "a2", 3: "b0", 4: "b1", 6: "c0", 7: "c1"}
    assert got == {i: (f"/new/{p}", "rehoused") for i, p in moved.items()} | {5: ("/old/b5", "removed"), 8: ("/old/None8", "removed")}


def test_upsert_replaces_by_null_and_patch_does_not(spark):
    base = spark.createDataFrame([(1, "red", 30.0, "a"), (2, "blue", 10.0, "b")], "image_id long, cast_hue string, blur double, scene string")
    new = spark.createDataFrame([(1, None, None), (3, "green", 5.0)], "image_id long, cast_hue string, blur double")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(mutate.upsert(base, new, "image_id")) == [(1, None, None, "a"), (2, "blue", 10.0, "b"), (3, "green", 5.0, None)]
    assert rows(mutate.patch(base, new, "image_id")) == [(1, "red", 30.0, "a"), (2, "blue", 10.0, "b")]


def test_restore_replaces_present_paths_and_gives_way_to_taken_ids(spark):
    image, metric, verdict = "id long, path string, iso int", "image_id long, sharp double, hue string", "image_id long, verdict string, user_override boolean"
    images = spark.createDataFrame([(1, "/a", 100), (2, "/b", 200), (3, "/c", 300)], image)
    metrics = spark.createDataFrame([(1, 0.1, None), (2, 0.2, "red"), (3, 0.3, "blue")], metric)
    verdicts = spark.createDataFrame([(1, "reject", True), (2, "reject", False), (3, "reject", False)], verdict)
    archive, rest = mutate.archive_rejects(images, metrics, verdicts)
    assert rest.isEmpty()
    now = spark.createDataFrame([(7, "/a", 1), (2, "/other", 2)], image)  # /a was scanned again, the id of /b is another's
    i, m, v = mutate.restore_archive(archive, now, spark.createDataFrame([(7, 0.9, "green"), (2, 0.8, None)], metric), spark.createDataFrame([(7, "keeper", False), (2, "keeper", False)], verdict))
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(i) == [(2, "/other", 2), (3, "/c", 300), (7, "/a", 100), (8, "/b", 200)]
    assert got(m) == [(2, 0.8, None), (3, 0.3, "blue"), (7, 0.1, None), (8, 0.2, "red")]
    assert got(v) == [(2, "keeper", False), (3, "reject", False), (7, "reject", True), (8, "reject", False)]
