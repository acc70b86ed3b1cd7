"""Changes to catalogue tables, as DataFrame -> DataFrame; each takes a patch of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.shared import materialize


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Supplied columns of a known key are replaced, by null too; new keys are added, null where nothing is supplied. The columns
    are base's. Keys of updates are distinct; rows of base with a null key stay, and null keys of updates are added."""
    given = [c for c in updates.columns if c != key and c in base.columns]
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in given], F.lit(True).alias("_given"))
    joined = base.join(new, key, "full_outer")
    return joined.select(*[F.when(F.col("_given"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in base.columns])


def patch(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Supplied values of known keys that are not null win; unknown keys are skipped. Keys of updates are distinct."""
    given = [c for c in updates.columns if c != key and c in base.columns]
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in given])
    return base.join(new, key, "left").select(*[F.coalesce(f"new_{c}", c).alias(c) if c in given else F.col(c) for c in base.columns])


def with_new_ids(df: DataFrame, order: str, id_col: str = "id", known: DataFrame | None = None) -> DataFrame:
    """Rows whose id is null get ids after the largest, of df or of known, in an order."""
    from lumenlake.operators.bursts import numbered

    top = (df if known is None else known).agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    fresh = numbered(df.where(F.col(id_col).isNull()), order, "_n", 1).crossJoin(F.broadcast(top)).withColumn(id_col, F.col("_n") + F.col("top")).select(*df.columns)  # top is one row
    return df.where(F.col(id_col).isNotNull()).unionByName(fresh)


def upsert_images(images: DataFrame, updates: DataFrame) -> DataFrame:
    """By path; ids are kept, new rows get the next ones."""
    return with_new_ids(upsert(images, updates.drop("id"), "path"), "path")


def changed_images(images: DataFrame, updates: DataFrame) -> DataFrame:
    """The rows that upsert_images would change or add, alone."""
    known = images.join(updates, "path", "left_semi").select(*images.columns)
    return with_new_ids(upsert(known, updates.drop("id"), "path"), "path", known=images)


def save_verdicts(verdicts: DataFrame, new: DataFrame) -> DataFrame:
    """New verdicts replace old ones, but for those set by hand."""
    held = verdicts.where(F.coalesce("user_override", F.lit(False))).select("image_id")
    return upsert(verdicts, new.join(held, "image_id", "left_anti").withColumn("user_override", F.lit(False)), "image_id")


def override_verdicts(verdicts: DataFrame, given: DataFrame) -> DataFrame:
    """given: image_id and some of verdict, stars, label; marks the rows as set by hand; unknown ids are skipped."""
    return patch(verdicts, given.withColumn("user_override", F.lit(True)), "image_id")


def restore(verdicts: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of saved take the place of those with their ids."""
    return verdicts.join(saved, "image_id", "left_anti").unionByName(saved.join(verdicts, "image_id", "left_semi").select(*verdicts.columns))


def ensure_libraries(libraries: DataFrame, roots: DataFrame) -> DataFrame:
    """roots: root_path. Libraries of new roots are added once."""
    fresh = roots.select("root_path").distinct().join(libraries, "root_path", "left_anti")
    out = libraries.unionByName(fresh.withColumn("id", F.lit(None).cast(dict(libraries.dtypes)["id"])), allowMissingColumns=True)
    return with_new_ids(out, "root_path").select(*[F.col(c).cast(k).alias(c) for c, k in libraries.dtypes])


def merge_model_runs(libraries: DataFrame, runs: DataFrame) -> DataFrame:
    """runs: id, models_run, models_pending. Runs are merged by key, the new one winning; pending is replaced."""
    new = runs.select("id", F.col("models_run").alias("r"), F.col("models_pending").alias("p"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old = F.coalesce("models_run", none)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(F.coalesce("r", none), k)), F.coalesce("r", none))
    names = [c for c in libraries.columns if c not in ("models_run", "models_pending")]
    return libraries.join(new, "id", "left").select(*names, merged.alias("models_run"), F.coalesce("p", "models_pending").alias("models_pending"))


def delete_library(tables: dict[str, DataFrame], library_id: int) -> dict[str, DataFrame]:
    """libraries, images and, by image_id, every other table, without one library's rows."""
    own = tables["images"].where(F.col("library_id") == library_id).select(F.col("id").alias("image_id"))
    out = {}
    for name, df in tables.items():
        if name == "libraries":
            out[name] = df.where(F.col("id") != library_id)
        elif name == "images":
            out[name] = df.where(F.col("library_id").isNull() | (F.col("library_id") != library_id))
        else:
            out[name] = df.join(own, "image_id", "left_anti") if "image_id" in df.columns else df.where(F.col("library_id") != library_id)
    return out


def archive_rejects(images: DataFrame, metrics: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(archive: original_path, image_id, image, metrics, verdict as JSON; the remaining images). Photo-library packages are skipped."""
    reject = verdicts.where("verdict = 'reject'")
    rows = images.where(~F.col("path").contains(".photoslibrary")).join(reject.select(F.col("image_id").alias("id")), "id", "left_semi")
    as_json = lambda df, name: df.select("image_id", F.to_json(F.struct(*df.columns)).alias(name))
    out = rows.select(F.col("path").alias("original_path"), F.col("id").alias("image_id"), F.to_json(F.struct(*images.columns)).alias("image"))
    out = out.join(as_json(metrics, "metrics"), "image_id", "left").join(as_json(reject, "verdict"), "image_id", "left")
    return out, images.join(rows.select("id"), "id", "left_anti")


def restore_archive(archive: DataFrame, images: DataFrame, metrics: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, metrics, verdicts) with the archived rows back, the override flag included. An image that is at an archived path
    by now is replaced and keeps its id; an archived id that another path has by now gives way to a new one; metrics and
    verdicts follow their image's id, and what the archive has none of stays. Of rows archived for one path the one with the
    largest id counts."""
    named = [c for c in archive.columns if c in ("image", "metrics", "verdict")]
    last = archive.groupBy("original_path").agg(F.max(F.struct("image_id", *named)).alias("x")).select("x.*")
    image = last.select(F.from_json("image", images.schema).alias("x")).select("x.*")
    present = images.select("path", F.col("id").alias("_present"))
    taken = images.select("id", F.lit(True).alias("_taken"))
    own = F.coalesce("_present", F.when(F.col("_taken").isNull(), F.col("id")))
    back = image.join(present, "path", "left").join(taken, "id", "left").withColumn("id", own).select(*images.columns)
    after = materialize(with_new_ids(images.join(back, "path", "left_anti").unionByName(back), "path").select(*images.columns), "restored-images")
    ids = last.select(F.col("image_id").alias("_old"), F.from_json("image", images.schema)["path"].alias("path"), *[c for c in named if c != "image"]).join(after.select("path", "id"), "path")

    def children(table: DataFrame, name: str) -> DataFrame:
        rows = ids.where(F.col(name).isNotNull()).select("id", F.from_json(name, table.schema).alias("x"))
        rows = rows.select(*[F.col("id").cast(k).alias(c) if c == "image_id" else F.col(f"x.{c}").alias(c) for c, k in table.dtypes])
        return table.join(rows, "image_id", "left_anti").select(*table.columns).unionByName(rows)

    return after, children(metrics, "metrics"), children(verdicts, "verdict")


def backfill_libraries(images: DataFrame, libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, libraries): images without a library get that of their parent folder, made where missing."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    orphans = images.where("library_id is null").withColumn("root_path", folder)
    libraries = ensure_libraries(libraries, orphans.select("root_path"))
    names = libraries.select(F.col("id").alias("found"), "root_path").groupBy("root_path").agg(F.min("found").alias("found"))
    filled = images.withColumn("root_path", folder).join(names, "root_path", "left")
    kind = dict(images.dtypes)["library_id"]
    return filled.select(*[F.coalesce("library_id", F.col("found").cast(kind)).alias(c) if c == "library_id" else F.col(c) for c in images.columns]), libraries


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that went through, rows with an error)."""
    return results.where("error is null").drop("error"), results.where("error is not null").select("path", "error")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
