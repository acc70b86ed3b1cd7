"""The folder that driver and executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temp folder only for a single-JVM session that has none."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_lumenlake_dir", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="lumenlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = spark.sparkContext._lumenlake_dir = f"file://{folder}"
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lumenlake/{label}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Actions inside hand at most so many rows at once to Python: for rows that hold long arrays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenlake_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote, once nothing lazy reads them any more."""
    for df in tables:
        path = getattr(df, "_lumenlake_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
