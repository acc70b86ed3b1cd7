"""Near pairs of 64-bit hashes and of capture times, as equi-joins.

Rows with equal hashes are one node; the pairs are between distinct hashes, so a hot hash never meets itself. Where only
components are wanted, links join what near pairs join and are fewer than the nodes. The search itself is that of `hamming`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.hamming import BESIDE, hash_text, hash_value, near_links, near_pairs, near_values


def hash_pairs(df: DataFrame, bits: int = 10, scope: list[str] | None = None, hash_col: str = "phash") -> DataFrame:
    """Distinct scope columns (as text, null-safe), a < b: pairs of different hashes within bits of one another."""
    scope = scope or []
    named = [F.coalesce(F.col(s).cast("string"), F.lit("\0")).alias(s) for s in scope]
    key = F.xxhash64(*scope) if scope else F.lit(0).cast("long")
    rows = df.where(F.col(hash_col).isNotNull()).select(*named, hash_value(hash_col).alias("h")).withColumn("scope", key)
    met = near_values(rows.select("scope", "h").distinct(), bits)
    if scope:
        met = met.join(rows.select("scope", *scope).distinct(), "scope")
    return met.select(*scope, hash_text("a").alias("a"), hash_text("b").alias("b"))


def duplicate_links(df: DataFrame, bits: int = 10, id_col: str = "id", hash_col: str = "phash") -> DataFrame:
    """src, dst: links whose components are those of all pairs within bits; equal hashes hang on their least id."""
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), hash_value(hash_col).alias("h"))
    head = rows.groupBy("h").agg(F.min("id").alias("head"))
    stars = rows.join(head, "h").select(F.col("head").alias("src"), F.col("id").alias("dst"))
    near = near_links(head.select(F.lit(0).cast("long").alias("scope"), "h", F.col("head").alias("node")), bits)
    return stars.where("src <> dst").unionByName(near)


def hash_classes(df: DataFrame, id_col: str = "id", hash_col: str = "phash") -> DataFrame:
    """id, head (the least id with the same hash), copies: the classes whose heads pair_list pairs."""
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.lpad(F.lower(hash_col), 16, "0").alias("h"))
    return rows.join(rows.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("copies")), "h").select("id", "head", "copies")


def pair_list(df: DataFrame, bits: int = 10, id_col: str = "id", hash_col: str = "phash") -> DataFrame:
    """a < b, bits: heads of different hash classes within bits of one another; hash_classes names each head's copies."""
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), hash_value(hash_col).alias("h"))
    return near_pairs(rows.groupBy("h").agg(F.min("id").alias("node")).select(F.lit(0).cast("long").alias("scope"), "h", "node"), bits)


def burst_pairs(df: DataFrame, seconds: int = 3, bits: int = 10) -> DataFrame:
    """src, dst: links whose components are those of all pairs of one library (null only with null) whose hashes are within
    bits and whose times, whole seconds in capture_s, are within seconds of one another, or both missing.

    Rows with one library, time and hash are one node. A scope is a library's nodes from one second on until the limit, all of
    which are close in time, or those without a time: in a scope the search for near hashes goes by its size, so a moment of
    very many pictures costs little more than a library of as many. Scopes that follow one another meet in one group.
    """
    rows = df.where("phash is not null").select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("library_id").cast("string"), F.lit("\0")).alias("lib"), "capture_s", hash_value("phash").alias("h"))
    key = ["lib", "capture_s", "h"]
    head = rows.groupBy(*key).agg(F.min("id").alias("head"))
    r, d = rows.alias("r"), head.alias("d")
    stars = r.join(d, (F.col("r.lib") == F.col("d.lib")) & F.col("r.capture_s").eqNullSafe(F.col("d.capture_s")) & (F.col("r.h") == F.col("d.h"))).select(F.col("d.head").alias("src"), F.col("r.id").alias("dst"))
    starts = F.when(F.col("capture_s").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.floor("capture_s") - seconds, F.floor("capture_s")))
    beside = 1 << BESIDE
    scope = F.xxhash64("lib", F.col("start").isNull(), F.floor(F.col("start") / beside)).bitwiseAND(-beside) + F.coalesce(F.pmod("start", F.lit(beside)), F.lit(0))
    near = near_links(head.withColumn("start", F.explode(starts)).select(scope.alias("scope"), "h", F.col("head").alias("node")), bits)
    return stars.where("src <> dst").unionByName(near)
