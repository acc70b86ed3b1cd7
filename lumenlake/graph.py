"""Connected components by alternating large-star and small-star (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.shared import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's smallest neighbour, itself included."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to its smallest neighbour."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable.

    Self-loops name a node without linking it. Null ends are ignored. Each round is written to the
    shared folder, so a lost executor repeats one round at most.
    """
    named = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    named = materialize(named.distinct(), "edges")
    now = named.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(max_rounds):
        before, now = now, materialize(_small_star(_large_star(now)), "stars")
        release(before)
        # settled once every node hangs on one other alone, and nothing hangs on a node that hangs itself
        twice = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        deep = now.select(F.col("v").alias("u")).join(now.select("u"), "u", "left_semi")
        if twice.unionByName(deep).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = named.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    out = materialize(nodes.join(now.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component")), "components")
    release(named, now)
    return out


def extended(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """labels (node, component), as components gave them, after more edges: each component contracts to its label, and only the
    labels that new edges touch are joined anew. Nodes that are new are added; a component is still its least node."""
    named = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "new-edges")
    ends = named.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    of = materialize(ends.join(labels, "node", "left").withColumn("known", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "node")), "touched")
    side = lambda c, name: of.select(F.col("node").alias(c), F.col("component").alias(name))
    moved = components(named.join(side("u", "a"), "u").join(side("v", "b"), "v"), "a", "b")  # old label -> least label
    fresh = of.where("not known").select("node", F.col("node").alias("component"))
    rows = labels.select("node", "component").unionByName(fresh)
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to")).where("component <> to")
    return rows.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
