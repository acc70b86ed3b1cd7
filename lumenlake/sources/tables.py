"""Versioned tables of a catalogue: merge on read, one manifest for all tables of a batch.

A table is a base and changes on top of it, Parquet folders that are never changed once written. A change holds whole rows that
take the place of those with their keys, and keys that are gone; it is written in proportion to itself. A version of the
catalogue is a manifest, a small JSON file that names every table's folders in order; a batch writes its folders first and its
manifest last, under a name of its own and then renamed, so a run that is killed on the way leaves the version before it, for
all of its tables. There is one writer at a time.

Bases are parted by BUCKETS buckets of their key (images by library), so rows of a few keys are found without the rest.
Reading drops base rows whose keys have changed, and takes the last of a key's changes. Once the changes have more than
REWRITE of the base's rows the table is written anew, and once there are more than CHANGES of them they are written as one:
so a row is rewritten a bounded number of times, however many batches come.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: the columns that tell a table's rows apart; other tables are only written whole
KEYS = {"libraries": ["id"], "images": ["id"], "metrics": ["image_id"], "verdicts": ["image_id"], "members": ["burst_id", "image_id"], "bursts": ["burst_id"], "faces": ["id"]}
BUCKETS, REWRITE, CHANGES = 16, 0.5, 16


@dataclass(frozen=True)
class Change:
    """rows that replace those with their keys or are new (each key once), and the keys of rows that are gone."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Catalog:
    """Tables below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("manifests").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the whole versions, rising."""
        fs, folder = self._fs(), self._path("manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            return {"version": 0, "tables": {}}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} in {self.root}")
        stream = self._fs().open(self._path("manifests", f"{version or known[-1]}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, tables: dict, before: dict) -> int:
        number = before["version"] + 1
        fs, name, part = self._fs(), self._path("manifests", f"{number}.json"), self._path("manifests", f"{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps({"version": number, "tables": tables}).encode()))
        stream.close()
        if fs.exists(name) or not fs.rename(part, name):
            raise RuntimeError(f"version {number} of {self.root} was written meanwhile")
        return number

    def _write(self, name: str, df: DataFrame, by: list[str]) -> dict:
        """A folder with df and what a manifest says of it."""
        path = f"data/{name}/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.root}/{path}")
        return {"path": path, "schema": df.schema.json(), "rows": self._read({"path": path, "schema": df.schema.json()}).count()}

    def _read(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(segment["schema"]))).parquet(f"{self.root}/{segment['path']}")

    def _base(self, name: str, df: DataFrame) -> dict:
        key = KEYS.get(name)
        if name == "images":
            segment = self._write(name, df, ["library_id"])
        elif key and set(key) <= set(df.columns):
            segment = self._write(name, df.withColumn("_bucket", _bucket(key)), ["_bucket"])
        else:
            segment = self._write(name, df, [])
        return {"base": segment, "changes": []}

    def save(self, name: str, df: DataFrame) -> int:
        """Write a table whole, from the present one too, and return the version."""
        return self.save_all({name: df})

    def save_all(self, tables: dict[str, DataFrame]) -> int:
        """Write tables whole, as one version."""
        before = self._manifest()
        return self._publish(before["tables"] | {n: self._base(n, df) for n, df in tables.items()}, before)

    def commit(self, changes: dict[str, Change], whole: dict[str, DataFrame] | None = None) -> int:
        """Write changes of tables, and tables that are replaced whole, as one version; return it."""
        before = self._manifest()
        tables = dict(before["tables"])
        for name, change in changes.items():
            key = KEYS[name]
            own = dict(tables.get(name) or self._base(name, change.rows.limit(0)))
            parts = [] if change.rows is None else [change.rows.withColumn("_gone", F.lit(False))]
            parts += [] if change.gone is None else [change.gone.select(*key).withColumn("_gone", F.lit(True))]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            segment = self._write(name, rows, [])
            if segment["rows"]:
                own["changes"] = [*own["changes"], segment]
            tables[name] = self._tidied(name, own)
        tables |= {n: self._base(n, df) for n, df in (whole or {}).items()}
        return self._publish(tables, before)

    def _tidied(self, name: str, table: dict) -> dict:
        changed = sum(c["rows"] for c in table["changes"])
        if changed > REWRITE * table["base"]["rows"] and changed:
            return self._base(name, self._merged(name, table))
        if len(table["changes"]) > CHANGES:
            return table | {"changes": [self._write(name, self._last(name, table), [])]}
        return table

    def _last(self, name: str, table: dict) -> DataFrame:
        """The last change of every key, with _gone."""
        parts = [self._read(c).withColumn("_order", F.lit(i)) for i, c in enumerate(table["changes"])]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        latest = F.row_number().over(Window.partitionBy(*KEYS[name]).orderBy(F.desc("_order")))
        return rows.withColumn("_rank", latest).where("_rank = 1").drop("_rank", "_order")

    def _merged(self, name: str, table: dict, buckets: list[int] | None = None) -> DataFrame:
        base = self._read(table["base"])
        if "_bucket" in base.columns:
            base = (base if buckets is None else base.where(F.col("_bucket").isin(buckets))).drop("_bucket")
        if not table["changes"]:
            return base
        last = self._last(name, table)
        kept = base.join(last.select(*KEYS[name]), KEYS[name], "left_anti").select(*base.columns)
        return kept.unionByName(last.where("not _gone").drop("_gone"), allowMissingColumns=True)

    def load(self, name: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """A table at the latest version, or the one given, with the columns of schema; an empty one where there is none."""
        table = self._manifest(version)["tables"].get(name)
        if table is None and schema:
            return self.spark.createDataFrame([], schema)
        if table is None:
            raise ValueError(f"no table {name} in {self.root}")
        return _shaped(self._merged(name, table), schema)

    def find(self, name: str, keys: DataFrame, schema: str | None = None) -> DataFrame:
        """The rows of keys (a table's key columns), from their buckets of the base alone."""
        key = KEYS[name]
        table = self._manifest()["tables"].get(name)
        if table is None:
            return self.load(name, schema)
        wanted = keys.select(*key).distinct()
        buckets = [r[0] for r in wanted.select(_bucket(key)).distinct().collect()]  # at most BUCKETS
        return _shaped(self._merged(name, table, buckets), schema).join(wanted, key, "left_semi")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders and manifests that none of the last versions name, those of killed runs too; how many folders."""
        known = self.versions()
        held = {s["path"] for v in known[-keep:] for t in self._manifest(v)["tables"].values() for s in (t["base"], *t["changes"])}
        fs, gone = self._fs(), 0
        for table in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            for segment in fs.listStatus(table.getPath()):
                if f"data/{table.getPath().getName()}/{segment.getPath().getName()}" not in held:
                    gone += fs.delete(segment.getPath(), True)
        for v in known[:-keep]:
            fs.delete(self._path("manifests", f"{v}.json"), False)
        return gone


def _bucket(key: list[str]):
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(BUCKETS)).cast("int").alias("_bucket")


def _shaped(df: DataFrame, schema: str | None) -> DataFrame:
    if not schema:
        return df
    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
