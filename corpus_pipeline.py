"""A training-data pipeline: five stages over the documents table, each written as Parquet before the next.

A stage decides about rows by their content, never by doc_id alone: two 64-bit hashes of the columns that its decision rests
on. Null or repeated ids therefore neither lose nor multiply rows.

Defined results of the stages, on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns:
quality and decontamination judge every row on its text (and language), so identical rows stand or fall together, and a null
or empty text fails the quality rules and holds no benchmark passage. near_dedup keeps one row of each group, that with the
least id (null ids last, then the least digest of its columns), and one of identical rows; texts without words are
near copies of nothing, but one of identical rows stays. secrets keeps every row; a null text stays null. mixing gives every
row with copies at most one place; identical rows stand or fall together. An empty table gives an empty table. The result
has the columns of documents (mixing: also domain, n_tokens, copies); other columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.llm.decontaminate import decontaminate
from lumenlake.llm.mixing import mix
from lumenlake.llm.near_dup import near_duplicates
from lumenlake.llm.quality import judge
from lumenlake.llm.secrets import redact
from lumenlake.shared import materialize, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEY = ("_k1", "_k2")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with KEY, 128 bits of these columns' content, in which null is a value."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.select(*COLUMNS).withColumns({k: F.xxhash64(F.lit(k), *parts) for k in KEY})


def _digest(*columns: str) -> Column:
    """md5 of the columns' content, in which null is a value."""
    return F.md5(F.concat_ws("\0", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in columns]))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the perplexity bands keep."""
    rows = _keyed(docs, "text", "lang")
    kept = judge(rows, keep=KEY).where("kept").select(*KEY).distinct()
    return rows.join(kept, list(KEY), "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group of near copies: five words, 0.8."""
    # ids in order, null last; the sign bit is flipped for the order of bytes
    order = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rows = docs.select(*COLUMNS).withColumn("_row", F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), order), F.lit("01")), _digest(*COLUMNS))))
    kept = near_duplicates(rows, k=5, percent=80, id_col="_row").where("kept").select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    rows = _keyed(docs, "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate(rows, bench, keep=KEY).where("contaminated").select(*KEY).distinct()
    return rows.join(hit, list(KEY), "left_anti").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind; n_chars follows the text."""
    clean = redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, with how many copies of each."""
    taken = mix(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "domain", "n_tokens", "copies").distinct()
    rows = docs.select(*COLUMNS)
    named = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    same = (F.md5(F.coalesce("text", F.lit(""))) == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (named("lang") == F.col("_lang")) & (named("source") == F.col("_source"))
    return rows.join(taken, same).select(*COLUMNS, "domain", "n_tokens", "copies")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: the first stage's perplexity bands are beyond SQL; tests/llm/test_pipeline.py holds every stage against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return docs
