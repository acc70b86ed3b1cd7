"""A timeline cut into events where it pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_events(images: DataFrame, gap: int = 6 * 3600, time_col: str = "capture_s", id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(events: event_id, label, start_s, end_s), (members: event_id, image_id); null times belong to none.

    Buckets are as wide as the gap, so that a pause longer than it always shows between two buckets' extremes; only the
    bucket table, one row a gap of time, is put in order.
    """
    rows = images.where(F.col(time_col).isNotNull()).select(F.col(id_col).alias("image_id"), F.col(time_col).alias("t")).withColumn("bucket", F.floor(F.col("t") / gap))
    buckets = rows.groupBy("bucket").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    order = Window.orderBy("bucket")
    starts = buckets.withColumn("new", F.coalesce((F.col("low") - F.lag("high").over(order) > gap).cast("long"), F.lit(1).cast("long")))
    named = starts.withColumn("event_id", F.sum("new").over(order) - 1)
    members = rows.join(named.select("bucket", "event_id"), "bucket").select("event_id", "image_id", "t")
    events = named.groupBy("event_id").agg(F.min("low").alias("start_s"), F.max("high").alias("end_s")).select("event_id", F.format_string("event-%04d", "event_id").alias("label"), "start_s", "end_s")
    return events, members.select("event_id", "image_id")


def event_labels(events: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(events, "event_id").select("image_id", F.col("label").alias("event_label"))


def split_by_key(rows: DataFrame, key: str, gap: int = 6 * 3600, time_col: str = "capture_s", id_col: str = "id") -> DataFrame:
    """key, id, event_no from 0 within each key; a null key is a key. As split_events, only a row a gap and key is put in order."""
    timed = rows.where(F.col(time_col).isNotNull()).select(F.col(key).alias("_key"), F.col(id_col).alias("_id"), F.floor(F.col(time_col) / gap).alias("_bucket"), F.col(time_col).alias("_t"))
    buckets = timed.groupBy("_key", "_bucket").agg(F.min("_t").alias("low"), F.max("_t").alias("high"))
    order = Window.partitionBy("_key").orderBy("_bucket")
    new = F.coalesce((F.col("low") - F.lag("high").over(order) > gap).cast("long"), F.lit(0).cast("long"))
    named = buckets.withColumn("new", new).withColumn("event_no", F.sum("new").over(order)).select(F.col("_key").alias("_k"), F.col("_bucket").alias("_b"), "event_no")
    joined = timed.join(named, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(F.col("_key").alias(key), F.col("_id").alias(id_col), "event_no")
