"""Listings, filters, sorts, histograms, facets and statistics over the catalogue."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.detections import merge_animals
from lumenlake.functions.tokens import aperture_bucket, iso_bucket, orientation
from lumenlake.functions.values import hsl, hue_distance


def list_images(images: DataFrame, verdicts: DataFrame, metrics: DataFrame, members: DataFrame, verdict=None, burst=None, library_id=None, folder=None, content_type=None) -> DataFrame:
    """One row an image with its verdict, metrics and burst, by the filters given; order and paging are page()'s."""
    out = images.join(verdicts.withColumnRenamed("image_id", "id"), "id", "left").join(metrics.withColumnRenamed("image_id", "id"), "id", "left").join(members.withColumnRenamed("image_id", "id"), "id", "left")
    for value, test in ((verdict, F.col("verdict") == verdict), (burst, F.col("burst_id") == burst), (library_id, F.col("library_id") == library_id), (content_type, F.col("content_type") == content_type)):
        out = out.where(test) if value is not None else out
    return out.where(F.col("path").startswith(folder.rstrip("/") + "/")) if folder else out


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("capture_s"), "id").offset(offset).limit(limit)


@dataclass(frozen=True)
class Filters:
    """Facets that are None, False or empty are off."""

    verdict: str | None = None
    stars_min: int = 0
    sharpness_min: float = 0.0
    aesthetic_min: float = 0.0
    reason_blur: bool = False
    reason_eyes: bool = False
    reason_exposure: bool = False
    reason_tilt: bool = False
    reason_cast: bool = False
    content_type: str | None = None
    scene: str | None = None
    has_ocr: bool = False
    ocr_text: str | None = None
    has_animals: bool = False
    temperature: str | None = None
    saturation: str | None = None
    cast_hue: str | None = None
    hue_anchors: tuple[float, ...] = ()
    hue_tolerance: float = 20.0
    hue_min_sat: float = 0.15
    camera: str | None = None
    iso: str | None = None
    aperture: str | None = None
    orientation: str | None = None
    date_from_s: int | None = None
    date_to_s: int | None = None
    path_contains: str | None = None
    burst_only: bool = False
    burst_best: bool = False


def predicates(f: Filters) -> list[Column]:
    said = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.coalesce("warnings", F.array().cast("array<string>")))
    says = lambda form: F.exists(said, lambda r: F.lower(r).rlike(form))
    near_hue = lambda: F.exists("dominant", lambda c: (hsl(c[0], c[1], c[2])["s"] >= f.hue_min_sat) & F.exists(F.array(*map(F.lit, f.hue_anchors)), lambda a: hue_distance(hsl(c[0], c[1], c[2])["h"], a) <= f.hue_tolerance))
    tests = {
        "verdict": lambda v: F.col("verdict") == v,
        "stars_min": lambda v: F.coalesce("stars", F.lit(0)) >= v,
        "sharpness_min": lambda v: F.coalesce("sharp_score", F.lit(0.0)) >= v,
        "aesthetic_min": lambda v: F.coalesce("aesthetic_score", F.lit(0.0)) >= v,
        "reason_blur": lambda v: says("focus|soft|blur"),
        "reason_eyes": lambda v: says("eyes"),
        "reason_exposure": lambda v: says("exposed"),
        "reason_tilt": lambda v: says("tilt"),
        "reason_cast": lambda v: says("cast"),
        "content_type": lambda v: F.coalesce("content_type", F.lit("photo")) == v,
        "scene": lambda v: F.col("scene") == v,
        "has_ocr": lambda v: F.size("ocr") > 0,
        "ocr_text": lambda v: F.exists("ocr", lambda o: F.lower(o["text"]).contains(v.lower())),
        "has_animals": lambda v: F.size("animals") > 0,
        "temperature": lambda v: F.col("temperature") == v,
        "saturation": lambda v: F.col("saturation") == v,
        "cast_hue": lambda v: F.col("cast_hue") == v,
        "hue_anchors": lambda v: near_hue(),
        "camera": lambda v: F.col("camera_model") == v,
        "iso": lambda v: iso_bucket("iso", missing="low", prefix="") == v,
        "aperture": lambda v: aperture_bucket("f_number") == v,
        "orientation": lambda v: orientation("width", "height", missing="landscape") == v,
        "date_from_s": lambda v: F.col("capture_s") >= v,
        "date_to_s": lambda v: F.col("capture_s") <= v,
        "path_contains": lambda v: F.lower("path").contains(v.lower()),
        "burst_only": lambda v: F.col("burst_id").isNotNull(),
        "burst_best": lambda v: F.col("is_best"),
    }
    return [tests[x.name](v) for x in fields(f) if x.name in tests and (v := getattr(f, x.name)) not in (None, False, (), 0, 0.0)]


def filter_images(df: DataFrame, f: Filters) -> DataFrame:
    for p in predicates(f):
        df = df.where(p)
    return df


def scope(df: DataFrame, ids: DataFrame | None = None, library_id: int | None = None) -> DataFrame:
    out = df.where(F.col("library_id") == library_id) if library_id is not None else df
    return out.join(ids.select("id"), "id", "left_semi") if ids is not None else out


def sort_key(key: str) -> Column:
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    rank = F.when(F.col("temperature") == "cool", 1).when(F.col("temperature") == "neutral", 2).when(F.col("temperature") == "warm", 3).otherwise(0)
    named = {"timestamp": "capture_s", "aesthetic": "aesthetic_score", "sharpness": "sharp_score", "stars": "stars", "iso": "iso", "exposure": "exposure_time"}
    if key in named:
        return zero(named[key])
    return {"aperture": F.coalesce("f_number", F.lit(999.0)), "temperature": rank, "filename": F.element_at(F.split("path", "/"), -1)}[key]


def sort_images(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    c = sort_key(key)
    return df.orderBy(c.desc() if descending else c.asc(), "id")


def histogram(df: DataFrame, column: str, bins: int = 30, threshold: float = 0.0) -> DataFrame:
    """bin 0..bins-1, n, passing (rows at or over the threshold): dense."""
    v = F.coalesce(F.col(column), F.lit(0.0))
    spot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(v * bins))).cast("int")
    got = df.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.count_if(v >= threshold).alias("passing"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("passing", F.lit(0)).alias("passing"))


def timeline(df: DataFrame, cells: int = 60, time_col: str = "capture_s") -> DataFrame:
    """cell, n between the first and the last time; all zero if there is no span."""
    ends = df.agg(F.min(time_col).alias("low"), F.max(time_col).alias("high"))
    placed = df.where(F.col(time_col).isNotNull()).crossJoin(F.broadcast(ends)).where("high > low")  # ends is one row
    spot = F.least(F.lit(cells - 1), F.floor((F.col(time_col) - F.col("low")) * cells / (F.col("high") - F.col("low")))).cast("int")
    got = placed.groupBy(spot.alias("cell")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(cells).select(F.col("id").cast("int").alias("cell")).join(got, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n for the non-empty values of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def library_statistics(libraries: DataFrame, images: DataFrame, verdicts: DataFrame, errors: DataFrame) -> DataFrame:
    """id, root_path, added_at where libraries have it, images, errors, keeper, review, reject; libraries without images too, the
    latest added first, then the largest id."""
    per = images.join(verdicts.select(F.col("image_id").alias("id"), "verdict"), "id", "left").groupBy("library_id").agg(F.count("*").alias("images"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("keeper", "review", "reject")])
    bad = errors.groupBy("library_id").agg(F.count("*").alias("errors"))
    out = libraries.join(per.withColumnRenamed("library_id", "id"), "id", "left").join(bad.withColumnRenamed("library_id", "id"), "id", "left")
    added = [c for c in ("added_at",) if c in libraries.columns]
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("images", "errors", "keeper", "review", "reject")]
    return out.select("id", "root_path", *added, *counts).orderBy(*[F.desc_nulls_last(c) for c in added], F.desc("id"))


def global_statistics(images: DataFrame, verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """images, libraries, keeper, review, reject, bursts: one row."""
    a = images.agg(F.count("*").alias("images"), F.countDistinct("library_id").alias("libraries"))
    b = verdicts.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("keeper", "review", "reject")])
    c = members.agg(F.countDistinct("burst_id").alias("bursts"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def burst_counts(members: DataFrame, images: DataFrame, library_id: int | None = None) -> DataFrame:
    rows = members.join(scope(images, library_id=library_id).select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return rows.groupBy("burst_id").agg(F.count("*").alias("n"))


def bursts_per_library(members: DataFrame, images: DataFrame) -> DataFrame:
    return members.join(images.select(F.col("id").alias("image_id"), "library_id"), "image_id").where("library_id is not null").groupBy("library_id").agg(F.countDistinct("burst_id").alias("bursts"))


def cluster_cards(faces: DataFrame, labels: DataFrame, min_size: int = 2, most: int = 12) -> DataFrame:
    """cluster_id, label, images (distinct), best_face, shown: up to most images by their best face's quality."""
    rows = faces.where("cluster_id is not null").withColumn("q", F.coalesce("quality", F.lit(-1.0)))
    best_in_image = rows.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id", "image_id").orderBy(F.desc("q"), "id"))).where("r = 1")
    ranked = best_in_image.withColumn("r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("q"), "id")))
    per = ranked.groupBy("cluster_id").agg(F.count("*").alias("images"), F.min(F.when(F.col("r") == 1, F.col("id"))).alias("best_face"), F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.struct("r", "image_id")))).alias("top"))
    out = per.where(F.col("images") >= min_size).join(labels, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("label"), "images", "best_face", F.transform("top", lambda x: x["image_id"]).alias("shown"))


def image_details(ids: DataFrame, images: DataFrame, verdicts: DataFrame, metrics: DataFrame, members: DataFrame) -> DataFrame:
    """Everything about the listed images (ids: id), one row each: image, verdict, metrics, burst; animals that the object
    detector saw are among the animals, where metrics have both arrays."""
    if {"animals", "objects"} <= set(metrics.columns):
        metrics = metrics.withColumn("animals", merge_animals("animals", "objects"))
    out = images.join(ids.select("id").distinct(), "id", "left_semi")
    for other in (verdicts, metrics, members):
        out = out.join(other.withColumnRenamed("image_id", "id"), "id", "left")
    return out


def cached_verdicts(paths: DataFrame, images: DataFrame, verdicts: DataFrame) -> DataFrame:
    """path, image_id, verdict, stars, label of the listed paths (path) that have a verdict, in order of path; none without paths."""
    found = images.join(paths.select("path").distinct(), "path", "left_semi").select("path", F.col("id").alias("image_id"))
    return found.join(verdicts.select("image_id", "verdict", "stars", "label"), "image_id").select("path", "image_id", "verdict", "stars", "label").orderBy("path")


def list_errors(errors: DataFrame, library_id: int | None = None, time_col: str = "at") -> DataFrame:
    """A library's ingest errors, newest first, then by path."""
    return scope(errors, library_id=library_id).orderBy(F.desc(time_col), "path")


def clear_errors(errors: DataFrame, libraries: DataFrame) -> DataFrame:
    """Errors but for those of libraries (id) that are analysed again."""
    return errors.join(libraries.select(F.col("id").alias("library_id")), "library_id", "left_anti").select(*errors.columns)


def bursts_with_members(members: DataFrame, least: int = 2) -> DataFrame:
    """burst_id, n, members (structs in order of image_id) of bursts of least images or more."""
    out = members.groupBy("burst_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("image_id", "is_best"))).alias("members"))  # a burst: pictures of one moment
    return out.where(F.col("n") >= least)


def stage_times(metrics: DataFrame, columns: list[str]) -> DataFrame:
    total = sum(F.sum(c) for c in columns)
    return metrics.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns], (F.count("*") / total).alias("images_per_second"))


def evaluate(df: DataFrame, label: str, checks: dict[str, Column]) -> DataFrame:
    """label, n and, for each named check, how many rows pass."""
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in checks.items()])


def contact_sheet(images: DataFrame, verdicts: DataFrame, verdict: str | None = "keeper") -> DataFrame:
    out = images.join(verdicts.withColumnRenamed("image_id", "id"), "id")
    out = out if verdict in (None, "all") else out.where(F.col("verdict") == verdict)
    name = F.element_at(F.split("path", "/"), -1)
    return out.orderBy(F.asc_nulls_last("capture_s"), "id").select("id", name.alias("name"), F.repeat(F.lit("★"), F.col("stars")).alias("rating"), "verdict", F.array_join("reasons", ", ").alias("reasons"))


def sidecars(images: DataFrame, verdicts: DataFrame, verdict: str | None = None, library_id: int | None = None) -> DataFrame:
    """sidecar_path and its XMP body."""

    def xml(c):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    out = scope(images, library_id=library_id).join(verdicts.withColumnRenamed("image_id", "id"), "id")
    out = out if verdict is None else out.where(F.col("verdict") == verdict)
    rating = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce("stars", F.lit(0)))).cast("string")
    label = F.when(F.col("label").isin("green", "yellow", "red"), F.initcap("label")).otherwise("")
    items = F.array_join(F.transform(F.coalesce("reasons", F.array().cast("array<string>")), lambda r: F.concat(F.lit("<rdf:li>"), xml(r), F.lit("</rdf:li>"))), "")
    body = F.concat(F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmp:Rating="'), rating, F.lit('" xmp:Label="'), label, F.lit('"><verdict>'), xml(F.coalesce("verdict", F.lit(""))), F.lit("</verdict><reasons><rdf:Bag>"), items, F.lit("</rdf:Bag></reasons></rdf:Description></rdf:RDF></x:xmpmeta>"))
    return out.select(F.concat("path", F.lit(".xmp")).alias("sidecar_path"), body.alias("body"))
