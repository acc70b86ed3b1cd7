"""URL filters: host and path rules first, else a naive Bayes verdict over segmented names.

Host labels that run words together are split by unigram Viterbi: candidate pieces are joined with word counts of the
pages' own text, without markup, and the best split is chosen for each distinct label. Multinomial naive Bayes learns from
the pages that a rule decides; its tokens are the pieces of the host's labels and the words of the path, numbers as one
token. What a rule itself reads is no token anywhere, neither the labels of the rules' hosts nor the words of their paths:
else the model would repeat the rules. Pages with equal tokens are scored once.

Defined results: a null url, or one without "://", has empty host and path, no rule and no tokens, and gets the more
frequent class of the learned pages, allow if there are none or as many; equal rows give equal results; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.shared import materialize, release

#: host/path, verdict
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: characters of a piece at most, which is the DNS's own limit of a label
PIECE = 63
#: markup, scripts and styles whole
MARKUP = r"(?is)<(script|style)\b.*?</(script|style)\s*>|<!--.*?-->|<[^>]*>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), form, i), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def by_rules(spark: SparkSession, addresses: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """addresses: distinct host, path. Adds rule and ruled, null where no rule fits; the longest rule wins."""
    table = spark.createDataFrame([(r, r.partition("/")[0], "/" + r.partition("/")[2], v) for r, v in rules], "rule string, rule_host string, rule_path string, ruled string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = addresses.withColumn("rule_host", F.explode(F.array_distinct(suffixes))).join(F.broadcast(table), "rule_host").where(F.col("path").startswith(F.col("rule_path")))  # rules: the caller's list
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.col("rule").alias("rule"), F.col("ruled").alias("ruled"))).alias("x"))
    return addresses.join(best, ["host", "path"], "left").select(*addresses.columns, F.col("x.rule").alias("rule"), F.col("x.ruled").alias("ruled"))


def rule_words(rules: Sequence[tuple[str, str]]) -> set[str]:
    """Labels of the rules' hosts and words of their paths."""
    return {w for rule, _ in rules for w in re.split(r"[^\w]+", rule.lower()) if w}


def word_counts(texts: DataFrame, text_col: str) -> DataFrame:
    """word, n: lower-cased runs of letters and digits of all texts, markup left out."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                plain = pc.replace_substring_regex(pc.fill_null(batch.column(0).slice(i, 500), ""), MARKUP, " ")
                words = pc.list_flatten(pc.split_pattern_regex(pc.utf8_lower(plain), r"[^\p{L}\p{N}]+"))
                got = pc.value_counts(words)
                yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], ["word", "n"])

    return texts.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("word <> ''")


def best_split(label: str, pieces: dict[tuple[int, int], float], total: float) -> list[str]:
    """Viterbi: the split of a label with the largest product of piece probabilities; an unknown piece of n
    characters has probability 1 / (total * 10**n)."""
    n = len(label)
    score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - PIECE), end):
            s = score[start] + pieces.get((start, end), -math.log(total) - (end - start) * math.log(10))
            if s > score[end]:
                score[end], back[end] = s, start
    out, at = [], n
    while at:
        out.append(label[back[at] : at])
        at = back[at]
    return out[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """labels: distinct label. Adds words, its best split by the counts (word, n)."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    spots = labels.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("label") - 1)))
    spots = spots.withColumn("end", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + PIECE, F.length("label")))))
    spots = spots.withColumn("word", F.expr("substring(label, start + 1, end - start)"))
    known = spots.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("start", "end", "n")).alias("pieces"))  # at most PIECE a character

    @F.pandas_udf("array<string>")
    def split(label: pd.Series, pieces: pd.Series) -> pd.Series:
        def one(text, own):
            own = own if isinstance(own, (list, np.ndarray)) else []
            return best_split(text, {(p["start"], p["end"]): math.log(p["n"] / total) for p in own}, float(total))

        return pd.Series([one(a, b) for a, b in zip(label, pieces, strict=True)])

    return labels.join(known, "label", "left").select("label", split("label", "pieces").alias("words"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", text: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (of block, by the model), for every page."""
    spark = pages.sparkSession
    rows = materialize(parts(pages.select("page_id", F.col(url).alias("url"))).select("page_id", "host", "path"), "addresses")
    seen = rows.groupBy("host", "path").agg(F.count("*").alias("pages"))
    ruled = materialize(by_rules(spark, seen, rules), "ruled")
    counts = materialize(word_counts(pages, text), "words")
    hosts = ruled.select("host").distinct()
    labels = hosts.select("host", F.posexplode(F.split("host", r"\.")).alias("i", "label")).where("label <> ''")
    labels = labels.where(~F.col("label").isin(sorted(rule_words(rules))))
    split = segment(labels.select("label").distinct(), counts)
    named = labels.join(split, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("names"))
    words = F.transform(F.regexp_extract_all(F.translate("path", UPPER, LOWER), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.regexp_replace(w, r"^\p{N}+$", "0"))
    none = F.array().cast("array<string>")
    read = [F.lit(w) for w in sorted(rule_words(rules))]
    bag = F.filter(F.concat(F.coalesce("names", none), words), lambda w: ~F.array_contains(F.array(*read) if read else none, w))
    bags = ruled.join(named, "host", "left").withColumn("bag", F.array_sort(bag))
    bags = materialize(bags.select("host", "path", "rule", "ruled", "pages", "bag"), "bags")

    learned = bags.where("ruled is not null").groupBy("bag", "ruled").agg(F.sum("pages").alias("pages"))
    priors = {r["ruled"]: r["n"] for r in learned.groupBy("ruled").agg(F.sum("pages").alias("n")).collect()}  # two classes
    of = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, F.col("pages")).otherwise(0))
    table = learned.select(F.explode("bag").alias("token"), "ruled", "pages").groupBy("token").agg(of("allow").alias("a"), of("block").alias("b"))
    table = materialize(table, "tokens")
    a, b, v = (float(x or 0) for x in table.agg(F.sum("a"), F.sum("b"), F.count("*")).first())
    start = math.log((priors.get("block", 0) + 1) / (priors.get("allow", 0) + 1))
    odds = lambda block, allow: F.log((block + 1) / F.lit(b + v + 1)) - F.log((allow + 1) / F.lit(a + v + 1))
    asked = bags.select("bag").distinct()
    tokens = asked.select("bag", F.explode("bag").alias("token"))
    scored = tokens.join(table, "token", "left").groupBy("bag").agg(F.sum(odds(F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0)))).alias("s"))
    judged = bags.join(scored, "bag", "left").withColumn("log_odds", F.lit(start) + F.coalesce("s", F.lit(0.0)))
    judged = judged.select("host", "path", "rule", F.coalesce("ruled", F.when(F.round("log_odds", 9) > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
    out = materialize(rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "log_odds"), "verdicts")
    release(rows, ruled, counts, bags, table)
    return out
