"""Files and pictures as tables."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.tokens import HEIC, JPEG, OTHER, RAW, col, file_kind
from lumenlake.sources.tables import Catalog

__all__ = ["Catalog", "content_key", "content_keys", "parse_metrics", "read_images", "scan_files", "supported"]

EDGE = 65536


def _bare() -> Column:
    return F.regexp_replace("path", "^file:/*", "/")


def _listed() -> Column:
    """Pictures; of a photo-library package only those below originals and masters."""
    in_package = F.lower("path").rlike(r"\.photoslibrary/")
    own = F.lower("path").rlike(r"\.photoslibrary/(originals|masters)/")
    return (~in_package | own) & (file_kind("path") != "unknown")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size_bytes, mtime (seconds), kind of all pictures below root, by their suffix in either case. Of a photo-library
    package only originals and masters are listed. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(_listed())
    return files.select(_bare().alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"), file_kind("path").alias("kind"))


def supported() -> tuple[str, ...]:
    return RAW + JPEG + HEIC + OTHER


def content_key(content: str | Column, length: str | Column) -> Column:
    """v2: and the SHA-1 of the size in digits, the first 64 KiB and, without overlap, the last 64 KiB."""
    data, n = col(content), col(length).cast("long")
    start = F.greatest(n - EDGE, F.lit(EDGE))
    tail = F.when(n > EDGE, F.substring(data, (start + 1).cast("int"), (n - start).cast("int"))).otherwise(F.lit(b""))
    return F.concat(F.lit("v2:"), F.sha1(F.concat(n.cast("string").cast("binary"), F.substring(data, F.lit(1), F.lit(EDGE)), tail)))


def content_keys(files: DataFrame) -> DataFrame:
    """files (path and more) with content_hash and bytes_read: tasks open each file and read its first and last 64 KiB, at most
    128 KiB whatever its length. A file that cannot be read has neither."""
    kinds = ", ".join(f"`{c}` {k}" for c, k in files.dtypes)

    def run(batches):
        for batch in batches:
            keys, sizes = zip(*[_ends_key(p) for p in batch.column(batch.schema.names.index("path")).to_pylist()], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.string()), pa.array(sizes, pa.int64())], [*batch.schema.names, "content_hash", "bytes_read"])

    return files.repartition("path").mapInArrow(run, f"{kinds}, content_hash string, bytes_read long")


def _ends_key(path: str) -> tuple[str | None, int | None]:
    """The key of content_key for a file, by its ends, and how many bytes were read for it."""
    try:
        store, name = (fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path))
        with store.open_input_file(name) as f:
            n = f.size()
            head = f.read(min(n, EDGE))
            start = max(n - EDGE, EDGE)
            tail = b""
            if n > EDGE:
                f.seek(start)
                tail = f.read(n - start)
    except OSError:
        return None, None
    return "v2:" + hashlib.sha1(str(n).encode() + head + tail).hexdigest(), len(head) + len(tail)


#: folders that are read one by one, rather than all below a root
FOLDERS = 1000


def read_images(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """path, width, height, channels, data (rows of BGR bytes) of the pictures that Spark's image source decodes; files that
    are not pictures are left out. only (path): of these files; the folders that hold them are read, and nothing below others,
    or all below root where they are more than FOLDERS or their names hold a pattern."""
    source = spark.read.format("image").option("dropInvalid", "true")
    if only is None:
        rows = source.option("recursiveFileLookup", "true").load(root)
    else:
        held = [r[0] for r in only.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).distinct().limit(FOLDERS + 1).collect()]
        if not held:
            rows = source.load(root).limit(0)
        elif len(held) > FOLDERS or any(set(h) & set("*?[]{}\\") for h in held):
            rows = source.option("recursiveFileLookup", "true").load(root)
        else:
            rows = source.load(held)
    rows = rows.select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data").where(_listed()).withColumn("path", _bare())
    return rows if only is None else rows.join(only.select("path").distinct(), "path", "left_semi")


def parse_metrics(df: DataFrame, schema: str, column: str = "metrics_json") -> DataFrame:
    """Metrics that arrive as JSON text, as typed columns; faulty text gives nulls."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.from_json(column, schema).alias("_m")).select(*kept, "_m.*")
