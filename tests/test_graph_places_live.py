"""Components after more edges, nearest places in dense cells, and live members of events."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.graph import components, extended
from lumenlake.operators.events import split_by_key
from lumenlake.operators.reconcile import nearest_place
from lumenlake.streaming import live


def test_extended_equals_a_full_run(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(5, 5), (None, 3)]
    df = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    labels = components(df(edges[:40]))
    for more in (edges[40:60], edges[60:], []):
        labels = extended(labels, df(more))
    got = {r.node: r.component for r in labels.collect()}
    assert got == {r.node: r.component for r in components(df(edges)).collect()}


def distance(a, b):
    x, y, u, v = map(math.radians, (*a, *b))
    return round(math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2, 12)


@pytest.mark.parametrize("leaf", [4, 64])
def test_nearest_place_equals_brute_force(spark, leaf):
    """Places in a dense town, along a border of cells, at the poles and the date line, and far apart."""
    rnd = random.Random(6)
    places = [(f"c{i % 5}", None if i % 9 == 0 else f"r{i % 3}", f"town {i}", 48.0 + rnd.gauss(0, 0.02), 11.0 + rnd.gauss(0, 0.02)) for i in range(150)]
    places += [("far", "r", f"far {i}", rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(20)]
    places += [("p", "n", "pole", 90.0, 0.0), ("p", "d", "line", 0.0, 180.0), ("a", "a", "twin", 10.0, 10.0), ("b", "a", "twin", 10.0, 10.0), ("z", "z", "none", None, 3.0)]
    spots = [(48.0 + rnd.gauss(0, 0.05), 11.0 + rnd.gauss(0, 0.05)) for _ in range(120)] + [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(60)]
    spots += [(10.0, 10.0), (89.9, 120.0), (0.0, -179.99), (48.0, 11.0), (48.0, 11.0), (None, 4.0), (4.0, None)]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(spots)], "id long, gps_lat double, gps_lon double")
    known = spark.createDataFrame(places, "country string, region string, city string, lat double, lon double")
    got = {r.id: (r.country, r.region, r.city) for r in nearest_place(df, known, leaf=leaf).collect()}
    for i, s in enumerate(spots):
        if None in s:
            assert got[i] == (None, None, None)
            continue
        d = {p[:3]: distance(s, p[3:]) for p in places if p[3] is not None}
        assert d[got[i]] == min(d.values())
    assert got[len(spots) - 7][0] == "a"  # the least names of equals
    assert nearest_place(df, known.drop("region"), leaf=leaf).where("region is not null").isEmpty()
    assert nearest_place(df, known.limit(0)).where("city is not null").isEmpty() and nearest_place(df.limit(0), known).isEmpty()


def test_missing_names_come_last_on_ties(spark):
    df = spark.createDataFrame([(1, 10.0, 10.0)], "id long, gps_lat double, gps_lon double")
    known = spark.createDataFrame([("a", None, "x", 10.0, 10.0), ("a", "r", "y", 10.0, 10.0), ("a", "r", None, 10.0, 10.0), (None, "b", "c", 10.0, 10.0)], "country string, region string, city string, lat double, lon double")
    assert nearest_place(df, known).first()[1:] == ("a", "r", "y")


def test_live_members_equal_the_batch_split(spark, tmp_path):
    rnd = random.Random(8)
    start, gap = dt.datetime(2024, 1, 1), 3600
    rows = [(rnd.choice(["a", "b", None]), i, start + dt.timedelta(seconds=rnd.choice([0, 600, 3600, 3601, 9000]) * rnd.randrange(1, 60))) for i in range(160)]
    rows.sort(key=lambda r: (r[2] + dt.timedelta(seconds=rnd.randrange(40_000)), r[1]))  # out of order, within the watermark
    last = max(r[2] for r in rows)
    rows += [(k, 1000 + j, last + dt.timedelta(days=9 * (j + 1))) for j in range(2) for k in ("a", "b", None)]  # lets the watermark pass the others
    schema, source = "k string, id long, ts timestamp", tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    parts = [rows[at : at + 40] for at in range(0, 160, 40)] + [rows[160:163], rows[163:]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        q = live.live_members(stream, "k", gap, "2 days").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    late = [("a", 5000, start - dt.timedelta(days=30))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(source))
    live.live_members(stream, "k", gap, "2 days").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(((r.k, r.id, r.event_no) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    batch = spark.createDataFrame(rows, schema).withColumn("capture_s", F.unix_seconds("ts"))
    want = {(r.k, r.id, r.event_no) for r in split_by_key(batch, "k", gap).collect()}
    assert len(got) == len(set(got)) and set(got) <= want
    assert {w for w in want if w[1] < 1000} <= set(got)  # all but rows that the watermark has not passed
