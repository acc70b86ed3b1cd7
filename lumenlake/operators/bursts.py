"""Burst groups and duplicate groups across libraries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.graph import components, extended
from lumenlake.operators.decide import burst_score, exposure_flags
from lumenlake.operators.pairs import burst_pairs, duplicate_links


@dataclass(frozen=True)
class BurstConfig:
    seconds: int = 3
    bits: int = 10


def group_bursts(images: DataFrame, metrics: DataFrame, config: BurstConfig = BurstConfig()) -> DataFrame:
    """burst_id, image_id, is_best. Groups of two or more, numbered from 1 in order of their earliest member (time, nulls
    last, then id); the best has the largest burst score, the earliest on ties."""
    label = components(burst_pairs(images, config.seconds, config.bits))
    rows = label.join(images.select(F.col("id").alias("node"), "capture_s"), "node").join(exposure_flags(metrics).select(F.col("image_id").alias("node"), F.round(burst_score(), 9).alias("s")), "node", "left")
    rank = Window.partitionBy("component").orderBy(F.desc_nulls_last("s"), F.asc_nulls_last("capture_s"), "node")
    rows = rows.withColumn("is_best", F.row_number().over(rank) == 1)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("capture_s").isNull(), "capture_s", "node")).alias("first"))
    return rows.join(numbered(first, "first", "burst_id", 1), "component").select("burst_id", F.col("node").alias("image_id"), "is_best")


def extended_bursts(images: DataFrame, fresh: DataFrame, labels: DataFrame, config: BurstConfig = BurstConfig()) -> DataFrame:
    """labels (node, component) of a library's bursts after new images, of which fresh has the ids: equal to a full run. Only
    images in the moments that new ones touch, and the untimed ones of their libraries if new ones are untimed, are compared;
    only labels that new links touch are joined anew. images hold the new ones too."""
    width = max(config.seconds, 1)
    lib, span = F.coalesce(F.col("library_id").cast("string"), F.lit("\0")), F.floor(F.col("capture_s") / width)
    placed = images.where("phash is not null").withColumns({"_lib": lib, "_span": F.coalesce(span, F.lit(-(1 << 62)))})
    new = placed.join(fresh.select("id"), "id", "left_semi")
    around = F.when(F.col("capture_s").isNull(), F.array("_span")).otherwise(F.array(F.col("_span") - 1, F.col("_span"), F.col("_span") + 1))
    touched = new.select("_lib", F.explode(around).alias("_span")).distinct()
    return extended(labels, burst_pairs(placed.join(touched, ["_lib", "_span"], "left_semi").select(*images.columns), config.seconds, config.bits))


def numbered(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df with consecutive numbers in the order of a column, without one task for all rows: ranges are counted, then ranked."""
    from lumenlake.shared import materialize

    ranged = materialize(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, (place + F.col("_before") - 1 + start).cast("long")).drop("_part", "_before")


def duplicate_groups(images: DataFrame, verdicts: DataFrame | None = None, bits: int = 10) -> DataFrame:
    """group_id (the least image id), image_id, library_id, verdict, stars, label: components that span two libraries."""
    label = components(duplicate_links(images, bits))
    rows = label.join(images.select(F.col("id").alias("node"), "library_id"), "node")
    wide = rows.groupBy("component").agg(F.countDistinct("library_id").alias("n")).where("n >= 2").select("component")
    out = rows.join(wide, "component").select(F.col("component").alias("group_id"), F.col("node").alias("image_id"), "library_id")
    if verdicts is None:
        return out
    v = verdicts.select("image_id", "verdict", "stars", "label")
    return out.join(v, "image_id", "left").select("group_id", "image_id", "library_id", F.coalesce("verdict", F.lit("review")).alias("verdict"), F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("label", F.lit("yellow")).alias("label"))


def duplicate_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.countDistinct("group_id").alias("groups"), F.count("*").alias("images"), F.countDistinct("library_id").alias("libraries"))


def demote(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """Keepers that are not their burst's best and were not set by hand become review, yellow; the rest stays."""
    worse = members.where("not is_best").select("image_id").distinct().withColumn("worse", F.lit(True))
    hit = F.col("worse").isNotNull() & (F.col("verdict") == "keeper") & ~F.coalesce("user_override", F.lit(False))
    out = verdicts.join(worse, "image_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return out.withColumn("verdict", F.when(F.col("hit"), "review").otherwise(F.col("verdict"))).withColumn("label", F.when(F.col("hit"), "yellow").otherwise(F.col("label"))).select(*verdicts.columns)


def regroup_library(members: DataFrame, images: DataFrame, new: DataFrame, library_id: int) -> DataFrame:
    """members without those of one library's images, and new groups numbered after them."""
    own = images.where(F.col("library_id") == library_id).select(F.col("id").alias("image_id"))
    rest = members.join(own, "image_id", "left_anti").select("burst_id", "image_id", "is_best")
    last = rest.agg(F.coalesce(F.max("burst_id"), F.lit(0)).alias("last"))
    return rest.unionByName(new.crossJoin(F.broadcast(last)).select((F.col("burst_id") + F.col("last")).alias("burst_id"), "image_id", "is_best"))  # last is one row


def regroup(images: DataFrame, metrics: DataFrame, verdicts: DataFrame, members: DataFrame, library_id: int, config: BurstConfig = BurstConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, bursts, verdicts) after one library is grouped anew: its old memberships go, pairs make new groups, keepers
    that are not their group's best are demoted, and bursts (burst_id) without members are swept."""
    from lumenlake.shared import materialize

    own = images.where(F.col("library_id") == library_id)
    new = materialize(group_bursts(own, metrics, config), "new-groups")
    after = materialize(regroup_library(members, images, new, library_id), "members")
    bursts = orphan_bursts(members.select("burst_id").union(after.select("burst_id")).distinct(), after)
    return after, bursts, demote(verdicts, after.join(own.select(F.col("id").alias("image_id")), "image_id", "left_semi"))


def apply_best_picks(members: DataFrame, picks: DataFrame) -> DataFrame:
    """picks: burst_id, image_id. The best moves to a picked member; picks of others are ignored."""
    valid = picks.join(members, ["burst_id", "image_id"], "left_semi").groupBy("burst_id").agg(F.max("image_id").alias("pick"))
    return members.join(valid, "burst_id", "left").select("burst_id", "image_id", F.when(F.col("pick").isNull(), F.col("is_best")).otherwise(F.col("image_id") == F.col("pick")).alias("is_best"))


def orphan_bursts(bursts: DataFrame, members: DataFrame) -> DataFrame:
    return bursts.join(members, "burst_id", "left_semi")
