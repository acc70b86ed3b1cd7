"""WARC archives of pages: written by Spark's text writer, read back by boundary-chain verification.

A record is a string of headers and an HTTP block, and the writer's line separator is the blank lines that end a record,
so that part files are archives. Equal payloads of at least LEAST bytes are kept once: the page with the smallest id is
the response, the others refer to it.

Reading: each file's task emits every place that looks like a record with the place where its stated length says the next
one begins. Pointer jumping from each file's start, over segments of SEGMENT bytes, keeps what the chain reaches; record
marks inside payloads are never reached. Archives are rows of Spark's binary file source: write_archives keeps each at about
FILE_BYTES.

Defined results: null html is an empty payload; a null url is about:blank; white space and control characters of a url
are percent-encoded in the header; a null page_id stays null; rows that share the smallest page_id of a payload are all
responses; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.shared import materialize, new_path

LEAST, FILE_BYTES, SEGMENT = 100, 16 << 20, 4 << 20
END = "\r\n\r\n"
MARK = re.compile(rb"WARC/1\.[01]\r\n")
NEEDED = (b"warc-type", b"content-length")


def with_originals(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    ids = rows.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, "payload_digest").where("page_id is null or page_id <> refers_to").distinct().toDF("d", "p", "refers_to")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left").drop("p", "d")


def record(date: str = "2024-01-01T00:00:00Z") -> Column:
    """The record's text, without the blank lines that end it."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    again = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    digest = F.md5(F.concat_ws("/", page, "payload_digest"))
    uuid = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    uri = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), uuid, F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-Id: "), page),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(again, F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"))),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Archives of about file_bytes each before gzip, by the mean record; pages stay in the partitions they are in."""
    rows = with_originals(pages, least)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, int(file_bytes / (mean + 600)))
    rows.select(record().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parsed(data: bytes, at: int) -> tuple | None:
    """Fields of the record that seems to begin at a place, None if it does not hold together."""
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if any(x not in fields for x in NEEDED) or not fields[b"content-length"].isdigit():
        return None
    begin = stop + 4
    end = begin + int(fields[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return None
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    kind = text(b"warc-type")
    body = data.find(b"\r\n\r\n", begin, end)
    digest = (text(b"warc-payload-digest") or "").removeprefix("sha256:")
    size = int(text(b"x-payload-length") or -1)
    if kind == "response" and body >= 0:
        size, digest = end - body - 4, hashlib.sha256(memoryview(data)[body + 4 : end]).hexdigest()
    return end + 4, kind, text(b"x-page-id"), size, digest, text(b"x-refers-to-page-id")


CANDIDATES = "file string, at long, next long, size long, record_type string, page string, payload_bytes long, payload_digest string, refers string"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place of every archive that may be a record, and its stated successor."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows = [(name, m.start(), p[0], len(data), *p[1:]) for m in MARK.finditer(data) if (p := _parsed(data, m.start()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, CANDIDATES)


NAMES = [c.split()[0] for c in CANDIDATES.split(", ")]
KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in CANDIDATES.split(", ")]


def _exits(found: DataFrame) -> DataFrame:
    """file, at, to: for places that another segment or the file's start may lead to, where their chain leaves the segment."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(f["at"], f["next"], strict=True))
        for at in sorted(to, reverse=True):
            to[at] = to.get(to[at], to[at])
        return pd.DataFrame({"file": f["file"], "at": f["at"], "to": f["at"].map(to)})

    return found.groupBy("file", "segment").applyInPandas(run, "file string, at long, to long")


def read_archives(spark: SparkSession, path: str, segment: int = SEGMENT) -> DataFrame:
    """page_id (string), payload_bytes, payload_digest, record_type, refers_to (string): one row for each record that
    the chain from its file's start reaches."""
    found = materialize(candidates(spark, path).withColumn("segment", F.expr(f"at div {segment}")), "candidates")
    jump = materialize(_exits(found.select("file", "at", "next", "segment")), "exits")
    reached = jump.where("at = 0").select("file", "at")
    most = found.agg(F.max("segment")).first()[0] or 0
    for _ in range(int(most + 1).bit_length()):
        reached = materialize(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
        jump = materialize(jump.join(jump.toDF("file", "to", "far"), ["file", "to"]).select("file", "at", F.col("far").alias("to")), "jump")
    doors = reached.groupBy("file", F.expr(f"at div {segment}").alias("segment")).agg(F.min("at").alias("door"))

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(f["at"], f["next"], strict=True))
        kept, at = set(), min(f["door"])
        while at in to:
            kept.add(at)
            at = to[at]
        return f[f["at"].isin(kept)][[*NAMES]]

    return found.join(doors, ["file", "segment"]).groupBy("file", "segment").applyInPandas(walk, CANDIDATES).select("page", "payload_bytes", "payload_digest", "record_type", "refers")


def archive_round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    kind = dict(pages.dtypes)["page_id"]
    back = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return read_archives(spark, path).select(back("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers").alias("refers_to"))
