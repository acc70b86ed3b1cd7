"""Mixing sources to target weights over a domain-language-source tree.

A node's capacity is its tokens times max_epochs, summed upwards. The total budget is handed down level by level:
siblings share their parent's budget by weight, none beyond its capacity, and what one cannot take goes to its
siblings in proportion to their weights (water-filling in closed form). As a parent never gets more than its children
can hold, a shortage stays among siblings and reaches an ancestor's siblings only when the whole family is full.

A leaf's documents stand in an order that md5(seed, epoch, doc_id) fixes. A leaf takes whole epochs while its budget
lasts, then the next epoch's longest prefix of documents whose tokens fit. The prefix is found by sums over PREFIX
hexadecimal digits of the order, so that only documents of the one slice at the border are ever ordered: a leaf with a
third of all rows is never in one task.

Defined results: tokens are words between white space, null or empty text has none and is taken with an epoch for
free; null language or source is "unknown"; rows with a null or repeated id are ordered by their text's md5 next;
identical rows stand or fall together; a leaf without tokens, or a weight that is not positive, gets no budget.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.skew import salt, salted
from lumenlake.shared import materialize

PREFIX = 3
#: the default tree: domains by the first digit of md5(source)
DOMAIN = "CASE WHEN substr(md5(source), 1, 1) < '6' THEN 'web' WHEN substr(md5(source), 1, 1) < 'b' THEN 'reference' ELSE 'forum' END"
WEIGHTS = {"web": 5, "reference": 3, "forum": 2, "web/en": 4, "reference/en": 4, "forum/en": 4}


def tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], tie: str) -> DataFrame:
    """nodes: parent columns, tie (a name unique among siblings), w, cap, total (the parent's budget). Adds budget."""
    fill = F.col("cap") / F.col("w")
    order = Window.partitionBy(*parent).orderBy(F.col("fill"), F.col(tie))
    family = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    live = nodes.where("w > 0 and cap > 0").withColumn("fill", fill)
    # the water level if all below are full and this one, with all above, is not; levels fall after the first that holds
    live = live.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    live = live.withColumn("at", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(family))
    return live.withColumn("budget", F.when(F.col("at").isNull() | (F.col("fill") < F.col("at")), F.col("cap")).otherwise(F.floor(F.col("w") * F.col("at"))).cast("long")).drop("fill", "level", "at")


def leaf_budgets(leaves: DataFrame, share: float, max_epochs: int, weights: Mapping[str, int]) -> DataFrame:
    """leaves: domain, lang, source, n_tokens. Adds budget, at most n_tokens * max_epochs."""
    weight = lambda path: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), path), F.lit(1)) if weights else F.lit(1)
    capped = leaves.withColumn("cap", F.col("n_tokens") * max_epochs)
    lang = capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    domain = lang.groupBy("domain").agg(F.sum("cap").alias("cap"))
    total = leaves.agg(F.floor(F.coalesce(F.sum("n_tokens"), F.lit(0)) * F.lit(share)).cast("long").alias("total"))
    domain = domain.crossJoin(F.broadcast(total)).withColumn("w", weight(F.col("domain"))).withColumn("root", F.lit(""))  # total is one row
    domain = water_fill(domain, ["root"], "domain").select("domain", F.col("budget").alias("total"))
    lang = water_fill(lang.join(domain, "domain").withColumn("w", weight(F.concat_ws("/", "domain", "lang"))), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    out = capped.join(lang, ["domain", "lang"]).withColumn("w", weight(F.concat_ws("/", "domain", "lang", "source")))
    return water_fill(out, ["domain", "lang"], "source").select("domain", "lang", "source", "n_tokens", "budget")


def mix(
    docs: DataFrame, share: float = 0.6, max_epochs: int = 4, weights: Mapping[str, int] = WEIGHTS, seed: int = 7, domain: str = DOMAIN, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, digest (md5 of the text), domain, lang, source, n_tokens, copies: how often each document is taken, for all documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("source", F.lit("unknown")).alias("source"), tokens(text_col).alias("n_tokens"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"))
    rows = materialize(rows.withColumn("domain", F.expr(domain)).withColumn("salt", salt("doc_id", "digest")), "tokens")
    key = ["domain", "lang", "source"]
    leaves = rows.groupBy(*key).agg(F.sum("n_tokens").alias("n_tokens"))
    budgets = leaf_budgets(leaves, share, max_epochs, weights).where("n_tokens > 0")
    budgets = materialize(budgets.select(*key, F.floor(F.col("budget") / F.col("n_tokens")).cast("int").alias("epochs"), F.expr("budget % n_tokens").alias("rest")), "budgets")
    rows = rows.join(salted(budgets), [*key, "salt"], "left").withColumn("epochs", F.coalesce("epochs", F.lit(0))).withColumn("rest", F.coalesce("rest", F.lit(0).cast("long")))
    rows = rows.withColumn("turn", F.md5(F.concat_ws("-", F.lit(seed), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    rows = rows.withColumn("slice", F.substring("turn", 1, PREFIX))
    sums = rows.groupBy(*key, "slice").agg(F.sum("n_tokens").alias("s"), F.max("rest").alias("r"))
    running = Window.partitionBy(*key).orderBy("slice")  # at most 16**PREFIX rows a leaf
    border = sums.withColumn("done", F.sum("s").over(running) - F.col("s")).where("done <= r and done + s > r").select(*key, F.col("slice").alias("border"), "done")
    rows = materialize(rows.join(salted(border), [*key, "salt"], "left"), "turns")
    plain = rows.where("border is null or slice <> border").withColumn("more", F.when(F.col("rest") == 0, 0).when(F.col("border").isNull() | (F.col("slice") < F.col("border")), 1).otherwise(0))
    step = Window.partitionBy(*key).orderBy("turn", "digest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("slice = border").withColumn("more", F.when((F.col("rest") > 0) & (F.col("done") + F.sum("n_tokens").over(step) <= F.col("rest")), 1).otherwise(0))
    return plain.unionByName(edge).select("doc_id", "digest", *key, "n_tokens", (F.col("epochs") + F.col("more")).alias("copies"))
