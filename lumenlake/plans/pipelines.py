"""Whole runs over a catalogue: ingest of folders, sync of a library, faces."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.operators import bursts, mutate, pixels, reconcile, vectors
from lumenlake.operators.decide import Thresholds, decide
from lumenlake.shared import materialize, release
from lumenlake.sources.files import content_keys, read_images, scan_files
from lumenlake.sources.tables import Catalog, Change
from lumenlake.streaming.live import VERDICTS

LIBRARIES = "id long, root_path string, models_run map<string,string>, models_pending array<string>"
MEMBERS, BURSTS = "burst_id long, image_id long, is_best boolean", "burst_id long"
#: the measures of an ingest, as a run of models
MODELS = {"pixels": "1", "decisions": "1"}
IMAGES = "id long, path string, size_bytes long, mtime double, content_hash string, capture_s long, camera_make string, camera_model string, width int, height int, phash string, library_id long"
ERRORS = "path string, error string, library_id long"
#: what decisions read beyond the pixel measures; detectors fill these columns in
DETECTED = {
    "subject_sharp_score": "double", "faces": "int", "closed_count": "int", "any_closed": "boolean", "occluded_count": "int", "min_ear": "double", "max_blink": "double",
    "max_smile": "double", "horizon_tilt_deg": "double", "thirds_offset": "double", "aesthetic_score": "double", "aesthetic_source": "string", "face_w": "int", "face_h": "int", "focus_on_background": "boolean",
}
MEASURED = {
    **{c: "double" for c in ("mean_luma", "clipped_highlight", "clipped_shadow", "dynamic_range", "laplacian_var", "tenengrad", "fft_anisotropy", "blur_angle_deg", "noise_sigma", "sharp_score", "cast_strength")},
    "cast_hue": "string", "temperature": "string", "saturation": "string", "decoded_long": "int",
}
METRICS = "image_id long, " + ", ".join(f"{c} {t}" for c, t in {**MEASURED, **DETECTED}.items())


def _of_folders(spark: SparkSession, libraries: DataFrame, roots: Sequence[str], read) -> DataFrame:
    """read(root)'s rows of all folders with their library; a file below two of them belongs to the inner one."""
    parts = [read(r).withColumn("root_path", F.lit(r)) for r in roots]
    rows = reduce(DataFrame.unionByName, parts).join(libraries.select(F.col("id").alias("library_id"), "root_path"), "root_path")
    inner = rows.groupBy("path").agg(F.max(F.struct(F.length("root_path"), "root_path")).alias("x")).select("path", F.col("x.root_path").alias("root_path"))
    return rows.join(inner, ["path", "root_path"]).drop("root_path")


def ingest_folders(spark: SparkSession, catalog: Catalog, roots: Sequence[str], t: Thresholds = Thresholds(), force: bool = False) -> None:
    """Measure and decide the pending pictures below the folders (trimmed, each once), a library for each, and save libraries,
    images, metrics, verdicts and errors; the libraries get MODELS among their runs and nothing pending. A picture that fails or that Spark cannot decode is an error; the others go on, and
    the errors of libraries that are read again are replaced. Files are listed without their contents; only pending ones are read.
    All tables change in one version."""
    roots = sorted({r.strip().rstrip("/") for r in roots if r.strip()})
    if not roots:
        return
    named = spark.createDataFrame([(r,) for r in roots], "root_path string")
    libraries = materialize(mutate.ensure_libraries(catalog.load("libraries", LIBRARIES), named), "libraries")
    images = catalog.load("images", IMAGES)
    files = materialize(_of_folders(spark, libraries, roots, lambda r: scan_files(spark, r)), "files")
    pending = files.join(reconcile.pending(files.select("path", "mtime"), images, force).select("path").distinct(), "path", "left_semi")
    fresh = materialize(content_keys(pending.drop("kind")).drop("bytes_read"), "pending")
    seen = reduce(DataFrame.unionByName, [read_images(spark, r, fresh.where(F.col("path").startswith(r + "/"))) for r in roots]).dropDuplicates(["path"])
    measured = materialize(pixels.derived(pixels.image_metrics(seen)), "measured")
    done, failed = mutate.split_errors(measured)

    changed = materialize(mutate.changed_images(images, fresh.join(done.select("path", "width", "height", "phash"), "path")), "changed")
    rows = done.withColumn("decoded_long", F.greatest("width", "height")).join(changed.select(F.col("id").alias("image_id"), "path"), "path")
    metrics = materialize(rows.select("image_id", *MEASURED, *[F.lit(None).cast(k).alias(c) for c, k in DETECTED.items()]), "new-metrics")
    by_hand = catalog.find("verdicts", metrics, VERDICTS).where(F.coalesce("user_override", F.lit(False)))
    verdicts = decide(metrics, t).join(by_hand, "image_id", "left_anti").withColumn("user_override", F.lit(False))

    unread = fresh.join(measured, "path", "left_anti").select("path", F.lit("not decoded").alias("error"))
    errors = failed.unionByName(unread).join(files.select("path", "library_id"), "path")
    own = libraries.join(named, "root_path", "left_semi")
    stamp = F.create_map(*[F.lit(x) for kv in MODELS.items() for x in kv])
    runs = own.select("id", stamp.alias("models_run"), F.array().cast("array<string>").alias("models_pending"))
    stamped = mutate.merge_model_runs(libraries, runs).select("id", "root_path", "models_run", "models_pending")
    kept = catalog.load("errors", ERRORS).join(own.select(F.col("id").alias("library_id")), "library_id", "left_anti").select("path", "error", "library_id")
    catalog.commit({"images": Change(changed.select(*images.columns)), "metrics": Change(metrics), "verdicts": Change(verdicts)}, whole={"libraries": stamped, "errors": kept.unionByName(errors)})
    release(libraries, files, fresh, measured, changed, metrics)


def sync_library(spark: SparkSession, catalog: Catalog, root: str, t: Thresholds = Thresholds(), captured: DataFrame | None = None) -> DataFrame:
    """Reconcile a library with its folder, drop what its removed images leave behind, bursts without members too, ingest what
    is new; id, path, status. captured (path, capture_s, camera_model): what a reader of capture data says of the files, for
    the match by size, time and camera."""
    root = root.strip().rstrip("/")
    library = catalog.load("libraries", LIBRARIES).where(F.col("root_path") == root).select(F.col("id").alias("library_id"))
    images = catalog.load("images", IMAGES)
    own = images.join(library, "library_id", "left_semi")
    listed = scan_files(spark, root).drop("kind")
    fresh = content_keys(listed.join(own, "path", "left_anti")).drop("bytes_read")  # what the catalogue knows by its path is not read
    files = listed.join(own, "path", "left_semi").withColumn("content_hash", F.lit(None).cast("string")).unionByName(fresh)
    none = {"capture_s": F.lit(None).cast("long"), "camera_model": F.lit(None).cast("string")}
    files = materialize(files.withColumns(none) if captured is None else files.join(captured.select("path", *none), "path", "left"), "listing")
    report = materialize(reconcile.reconcile(files, own), "reconciled")
    moved = report.where("status = 'rehoused'").select("id", F.col("path").alias("to"))
    gone = report.where("status = 'removed'").select("id")
    members = catalog.load("members", MEMBERS).join(gone.withColumnRenamed("id", "image_id"), "image_id", "left_anti").select("burst_id", "image_id", "is_best")
    children = gone.withColumnRenamed("id", "image_id")
    catalog.commit(
        {
            "images": Change(images.join(moved, "id").withColumn("path", F.col("to")).select(*images.columns), gone),
            "metrics": Change(catalog.load("metrics", METRICS).limit(0), children),
            "verdicts": Change(catalog.load("verdicts", VERDICTS).limit(0), children),
        },
        whole={"members": members, "bursts": bursts.orphan_bursts(catalog.load("bursts", BURSTS), members)},
    )
    release(files)
    ingest_folders(spark, catalog, [root], t)
    return report


def faces_run(faces: DataFrame, labels: DataFrame, config: vectors.ClusterConfig = vectors.ClusterConfig(), full: bool = False) -> tuple[DataFrame, DataFrame]:
    """(faces, labels): all faces clustered anew and labels re-anchored, or only faces without a cluster given one."""
    if full:
        new = materialize(faces.drop("cluster_id").join(vectors.cluster(faces, config.similarity), "id"), "clustered")
        return new, vectors.reanchor_labels(labels, vectors.centroids(faces), vectors.centroids(new), config.similarity)
    given = vectors.assign_new(faces, config.similarity).withColumnRenamed("cluster_id", "given")
    return faces.join(given, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "given")).drop("given"), labels
