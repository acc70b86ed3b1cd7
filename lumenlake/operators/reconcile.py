"""A file listing against the catalogue, and folder plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.functions.tokens import token
from lumenlake.operators.bursts import numbered
from lumenlake.shared import materialize, release


def pending(files: DataFrame, images: DataFrame, force: bool = False) -> DataFrame:
    """files (path, mtime) that are new, never analysed or changed in time; all if forced."""
    known = images.select("path", F.col("mtime").alias("known_mtime"), F.lit(True).alias("known"))
    out = files.join(known, "path", "left")
    return (out if force else out.where(F.col("known").isNull() | F.col("known_mtime").isNull() | (F.col("mtime") != F.col("known_mtime")))).select(*files.columns)


def _ranked(rows: DataFrame, column: str) -> DataFrame:
    """content_hash, the column and its rank within the hash, without one task for all copies: rows are numbered over all hashes."""
    distinct = rows.where("content_hash is not null").select("content_hash", column).distinct()
    all_ = numbered(distinct.withColumn("_order", F.struct("content_hash", column)), "_order", "_n")
    first = all_.groupBy("content_hash").agg(F.min("_n").alias("_first"))
    return all_.join(first, "content_hash").select("content_hash", column, (F.col("_n") - F.col("_first")).alias("rank"))


def reconcile(files: DataFrame, images: DataFrame) -> DataFrame:
    """id, path, status: kept, rehoused (path is the file's) or removed. A missing image is healed by a new file with its
    content hash, else by one whose size, time and camera match it alone; a file goes to the least image id. Of copies with one
    content hash, the images in order of id take the new files in order of path, one each."""
    kept = images.join(files, "path", "left_semi").select("id", "path", F.lit("kept").alias("status"))
    missing, fresh = images.join(files, "path", "left_anti"), files.join(images, "path", "left_anti")
    claim = lambda df: df.groupBy("new_path").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("new_path").alias("new_path"))
    by_hash = _ranked(missing, "id").join(_ranked(fresh.withColumnRenamed("path", "new_path"), "new_path"), ["content_hash", "rank"]).select("id", "new_path")
    left = missing.join(by_hash, "id", "left_anti")
    spare = fresh.join(by_hash.select(F.col("new_path").alias("path")), "path", "left_anti")
    sign = ["size_bytes", "capture_s", "camera_model"]
    single = spare.where("capture_s is not null and camera_model is not null").groupBy(*sign).agg(F.count("*").alias("n"), F.min("path").alias("new_path")).where("n = 1")
    by_sign = claim(left.join(single, sign).select("id", "new_path"))
    moved = by_hash.unionByName(by_sign).select("id", F.col("new_path").alias("path"), F.lit("rehoused").alias("status"))
    gone = missing.join(moved, "id", "left_anti").select("id", "path", F.lit("removed").alias("status"))
    return kept.unionByName(moved).unionByName(gone)


def orphans(listing: DataFrame, images: DataFrame) -> DataFrame:
    """Cached files (content_hash, size_bytes) of no catalogued image: how many, and their bytes."""
    return listing.join(images, "content_hash", "left_anti").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def live_pairs(files: DataFrame) -> DataFrame:
    """image path and the video beside it, the first of .mov .MOV .mp4 .MP4."""
    parts = files.select("path", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("stem"), F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ext"))
    order = F.array_position(F.array(*map(F.lit, (".mov", ".MOV", ".mp4", ".MP4"))), F.col("ext"))
    video = parts.withColumn("o", order).where("o > 0").groupBy("dir", "stem").agg(F.min(F.struct("o", F.col("path").alias("video"))).alias("v")).select("dir", "stem", F.col("v.video").alias("video"))
    return parts.where(order == 0).join(video, ["dir", "stem"]).select("path", "video")


#: width of the finest cells, on a sphere of radius 1, and how often they are joined four by four along each axis; the
#: neighbours of the coarsest hold every place
FINEST, LEVELS = 2.56 / 4**7, 7
#: places about a cell above which it is split, down to the finest width
LEAF = 64


def nearest_place(df: DataFrame, places: DataFrame, id_col: str = "id", leaf: int = LEAF) -> DataFrame:
    """id, country, region, city of the place nearest to gps_lat, gps_lon by great-circle distance; the least names on ties,
    missing ones last; null without coordinates or places.

    places (country, region, city, lat, lon; region may be missing) is a gazetteer. It makes a tree of cells: a cell lists the
    places in it and about it, and one with more than leaf places has finer cells below it. Distinct coordinates look into the
    finest cell that lists any, and a place no farther than its width is surely the nearest; the others climb to the next
    coarser cell. It is the gazetteer that is repeated in neighbouring cells, not the coordinates: these are one row each, and
    those of a hot cell are dealt to many tasks, with its few places.
    """
    rad = F.radians

    def point(df: DataFrame, lat: str, lon: str) -> DataFrame:
        axes = {"_x": F.cos(rad(lat)) * F.cos(rad(lon)), "_y": F.cos(rad(lat)) * F.sin(rad(lon)), "_z": F.sin(rad(lat))}
        return df.withColumns({c: F.floor(v / FINEST).cast("long") for c, v in axes.items()})

    named = places if "region" in places.columns else places.withColumn("region", F.lit(None).cast("string"))
    known = point(named.where("lat is not null and lon is not null").select("country", "region", "city", "lat", "lon"), "lat", "lon")
    far = F.pow(F.sin((rad("lat") - rad("gps_lat")) / 2), F.lit(2)) + F.cos(rad("gps_lat")) * F.cos(rad("lat")) * F.pow(F.sin((rad("lon") - rad("gps_lon")) / 2), F.lit(2))
    about = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    at = lambda level, by=(0, 0, 0): F.struct(*[(F.shiftright(c, 2 * level) + d).alias(c) for c, d in zip(("_x", "_y", "_z"), by, strict=True)])
    above = F.struct(*[F.shiftright(F.col(f"_cell.{c}"), 2).alias(c) for c in ("_x", "_y", "_z")])
    levels, full = [], None
    for level in range(LEVELS, -1, -1):
        listed = known.withColumn("_cell", F.explode(F.array(*[at(level, d) for d in about])))
        listed = listed if full is None else listed.join(full.withColumnRenamed("_cell", "_above"), F.col("_above") == above, "left_semi")
        levels.append((level, materialize(listed.select("_cell", "country", "region", "city", "lat", "lon"), "level")))
        full = levels[-1][1].groupBy("_cell").agg(F.count("*").alias("n")).where(F.col("n") > leaf).select("_cell")
        if full.isEmpty():
            break
        # finer cells only below full ones, of the places that these list
        known = point(levels[-1][1].join(full, "_cell", "left_semi").drop("_cell").distinct(), "lat", "lon")
    left = point(df.where("gps_lat is not null and gps_lon is not null").select("gps_lat", "gps_lon").distinct(), "gps_lat", "gps_lon")
    named_last = [c for n in ("country", "region", "city") for c in (F.col(n).isNull().alias(f"no_{n}"), F.col(n))]
    best = None
    for level, listed in reversed(levels):
        width = FINEST * 4**level
        met = left.withColumn("_cell", at(level)).join(listed, "_cell")
        met = met.groupBy("gps_lat", "gps_lon").agg(F.min(F.struct(F.round(far, 12).alias("d"), *named_last)).alias("b"))
        # the chord is twice the root of far
        sure = materialize(met if level == LEVELS else met.where(4 * F.col("b.d") <= 0.98 * width * width), "places")
        best = sure if best is None else best.unionByName(sure)
        left = left.join(sure, ["gps_lat", "gps_lon"], "left_anti")
    release(*[listed for _, listed in levels])
    found = df.select(id_col, "gps_lat", "gps_lon").join(best, ["gps_lat", "gps_lon"], "left")
    return found.select(id_col, *[F.col(f"b.{c}").alias(c) for c in ("country", "region", "city")])


def organize_plan(df: DataFrame, root: str, tokens: list[str], existing: DataFrame | None = None) -> DataFrame:
    """id, source, target. Tokens make the folders; a second row for a target, by id, or one that exists already gets a
    mark from its source's hash in its name."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = df.withColumn("target", F.concat_ws("/", F.lit(root.rstrip("/")), *[token(t) for t in tokens], name))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("id"))
    rows = rows.withColumn("again", rank > 1)
    if existing is not None:
        taken = existing.select(F.col("path").alias("target"), F.lit(True).alias("taken")).distinct()
        rows = rows.join(taken, "target", "left").withColumn("again", F.col("again") | F.coalesce("taken", F.lit(False)))
    mark = F.concat(F.lit("__"), F.substring(F.sha1("path"), 1, 6))
    marked = F.regexp_replace("target", r"(\.[^./]+)?$", "")
    ext = F.regexp_extract("target", r"(\.[^./]+)$", 1)
    return rows.select("id", F.col("path").alias("source"), F.when(F.col("again"), F.concat(marked, mark, ext)).otherwise(F.col("target")).alias("target"))


def apply_plan(images: DataFrame, plan: DataFrame, mode: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(images with moved paths, if the mode is move; the operations log: run_id, mode, image_id, source, target)."""
    ops = plan.select(F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"), F.col("id").alias("image_id"), "source", "target")
    if mode != "move":
        return images, ops
    to = plan.select("id", F.col("target").alias("new_path"))
    return images.join(to, "id", "left").withColumn("path", F.coalesce("new_path", "path")).select(*images.columns), ops


def undo_last(images: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with the latest run's moves taken back, the log without it). A move goes back if its image is still at its target:
    targets alone do not tell images apart, as the short marks in them may be equal."""
    last = ops.agg(F.max("run_id").alias("run_id"))
    mine = ops.join(F.broadcast(last), "run_id", "left_semi")  # one row
    back = mine.where("mode = 'move'").select(F.col("image_id").alias("id"), F.col("target").alias("path"), F.col("source").alias("old"))
    return images.join(back, ["id", "path"], "left").withColumn("path", F.coalesce("old", "path")).select(*images.columns), ops.join(F.broadcast(last), "run_id", "left_anti")
