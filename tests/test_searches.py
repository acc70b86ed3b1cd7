"""Near hashes, bursts of dense moments and vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.graph import components
from lumenlake.operators import cells, hamming, pairs, vectors

RNG = np.random.default_rng(5)


def random_values(n):
    return RNG.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + RNG.integers(0, 2, n, dtype=np.uint64)


def flipped(x, k):
    for b in RNG.choice(64, k, replace=False):
        x = x ^ (np.uint64(1) << np.uint64(b))
    return x


@pytest.fixture(scope="module")
def values():
    base = random_values(400)
    return np.unique(np.concatenate([base, *[np.array([flipped(x, int(RNG.integers(1, 13))) for x in base], np.uint64) for _ in range(2)]]))


def brute(v, radius):
    out = set()
    for i in range(len(v) - 1):
        near = np.flatnonzero(np.bitwise_count(v[i] ^ v[i + 1 :]) <= radius) + i + 1
        out |= {(int(min(v[i], v[j])), int(max(v[i], v[j]))) for j in near}
    return out


@pytest.mark.parametrize("way", hamming.WAYS)
@pytest.mark.parametrize("radius", [1, 4, 10])
def test_every_way_finds_every_pair_once(spark, values, monkeypatch, way, radius):
    monkeypatch.setattr(hamming, "limits", lambda r: ((1 << 40, way),))
    df = spark.createDataFrame([(int(i % 2), int(x.view(np.int64))) for i, x in enumerate(values)], "scope long, h long")
    got = [(r.scope, r.a % 2**64, r.b % 2**64) for r in hamming.near_values(df, radius).collect()]
    want = {(s, a, b) for s in (0, 1) for a, b in brute(values[s::2], radius)}
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_beyond_the_cap_are_split(spark, values, monkeypatch):
    """Half of the values agree in their upper half, so that one group of a mask holds them all."""
    same = (values[:300] & np.uint64(0xFFFFFFFF)) | np.uint64(0xABCDEF0100000000)
    v = np.unique(np.concatenate([values[300:600], same]))
    monkeypatch.setattr(hamming, "CAP", 40)
    monkeypatch.setattr(hamming, "limits", lambda r: ((1 << 40, "halves"),))
    df = spark.createDataFrame([(7, int(x.view(np.int64))) for x in v], "scope long, h long")
    got = [(r.a % 2**64, r.b % 2**64) for r in hamming.near_values(df, 10).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(v, 10)


@pytest.mark.parametrize("way", hamming.WAYS)
@pytest.mark.parametrize("radius", [0, 4, 10])
def test_links_join_what_pairs_join_and_are_few(spark, values, monkeypatch, way, radius):
    """A dense block, of which all pairs are near, gives no more links than it has values; sparse values lose none."""
    dense = (values[0] & ~np.uint64(0x3FF)) | np.arange(512, dtype=np.uint64)
    v = np.unique(np.concatenate([values, dense]))
    monkeypatch.setattr(hamming, "limits", lambda r: ((1 << 40, way),))
    monkeypatch.setattr(hamming, "CAP", 300)
    df = spark.createDataFrame([(3, int(x.view(np.int64)), i) for i, x in enumerate(v)], "scope long, h long, node long")
    links = hamming.near_links(df, radius).collect()
    place = {int(x): i for i, x in enumerate(v)}
    met = [(place[a], place[b]) for a, b in brute(v, radius)]
    join = lambda e: cells.joined_labels(np.arange(len(v)), np.array([x for x, _ in e], int), np.array([y for _, y in e], int)).tolist()
    assert join([(r.src, r.dst) for r in links]) == join(met)
    if way == "all":
        assert len(links) < len(v)


@pytest.mark.parametrize("at_once", [5, 1_000_000])
def test_pairs_of_nodes_and_their_bits(spark, values, monkeypatch, at_once):
    monkeypatch.setattr(hamming, "AT_ONCE", at_once)
    df = spark.createDataFrame([(3, int(x.view(np.int64)), i) for i, x in enumerate(values)], "scope long, h long, node long")
    want = [(*sorted((np.flatnonzero(values == a)[0], np.flatnonzero(values == b)[0])), (a ^ b).bit_count()) for a, b in brute(values, 10)]
    assert sorted((r.a, r.b, r.bits) for r in hamming.near_pairs(df, 10).collect()) == sorted(want)


def test_ways_grow_with_the_values():
    ways = [w for _, w in hamming.limits(10)]
    assert ways[0] == "all" and ways[-1] == "whole" and len(ways) == len(set(ways))
    chosen = lambda n: next(w for m, w in hamming.limits(10) if n <= m)
    assert chosen(1000) == "all" and chosen(100_000) == "halves" and chosen(4_000_000) == "thirds"


def test_dense_moment_equals_brute_force(spark, values):
    """All pictures in one second, most hashes distinct, some shared, and some without a time."""
    rows = [(i, None if i % 50 == 0 else 1, None if i % 7 == 0 else 1000 + i % 3 * 2, f"{int(values[i % len(values)]):016x}") for i in range(len(values) + 100)]
    df = spark.createDataFrame(rows, "id long, library_id int, capture_s long, phash string")
    got = {r.node: r.component for r in components(pairs.burst_pairs(df)).collect()}
    label = {r[0]: r[0] for r in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    touched = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and (a[2] is None) == (b[2] is None) and (a[2] is None or abs(a[2] - b[2]) <= 3) and (int(a[3], 16) ^ int(b[3], 16)).bit_count() <= 10:
                x, y = sorted((root(a[0]), root(b[0])))
                label[y] = x
                touched |= {a[0], b[0]}
    assert got == {i: root(i) for i in touched}


def test_a_dense_moment_has_few_links(spark):
    """400 pictures within three seconds whose hashes are all near one another: links do not grow with the square."""
    df = spark.createDataFrame([(i, 1, 1000 + i % 4, f"{0xABCD000000000000 + i:016x}") for i in range(400)], "id long, library_id int, capture_s long, phash string")
    links = pairs.burst_pairs(df)
    assert links.count() < 400 * 4 and {r.component for r in components(links).collect()} == {0}


@pytest.fixture(scope="module")
def blobs(spark):
    centres = RNG.normal(size=(12, 16))
    m = np.concatenate([c + RNG.normal(scale=0.05, size=(40, 16)) for c in centres] + [np.zeros((2, 16)), RNG.normal(size=(30, 16))])
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(3)


def cosines(m):
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return u @ u.T


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.1])
def test_pairs_by_cells_equal_all_pairs(spark, blobs, threshold):
    m, df = blobs
    i, j = np.nonzero(np.triu(cosines(m) >= threshold, 1))
    got = vectors.cosine_pairs(df, threshold, block=32, cell_rows=20).collect()
    assert sorted((r.src, r.dst) for r in got) == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_clusters_and_what_cells_leave_out(spark, blobs):
    m, df = blobs
    got = {r.id: r.cluster_id for r in vectors.cluster(df, 0.9, block=32, cell_rows=20).collect()}
    label = np.arange(len(m))
    i, j = np.nonzero(np.triu(cosines(m) >= 0.9, 1))
    label = cells.joined_labels(label, i, j)
    order = {int(x): n for n, x in enumerate(np.unique(label))}
    assert got == {k: order[int(x)] for k, x in enumerate(label)}
    directed = df.where(F.exists("embedding", lambda x: x != 0))
    to = cells.cells(directed, 20)
    assert cells.multiplied(cells.within(to, 0.9), to).first().multiplied < 0.5


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_nearest_by_cells_equals_all(spark, blobs, k):
    m, df = blobs
    s = np.round(cosines(m), 9)
    asked = [0, 50, 480, 481, 500]  # 480: a row of zeros
    got = vectors.top_k_batch(df, df.where(F.col("id").isin(asked)).select(F.col("id").alias("query_id"), "embedding"), k, block=32, cell_rows=20).collect()
    want = [(q, int(i), r + 1) for q in asked for r, i in enumerate(np.lexsort((np.arange(len(m)), -s[q]))[:k])]
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == sorted(want)


def test_rows_do_not_travel_to_the_cells_that_let_them_in(spark, blobs):
    m, df = blobs
    twice = df.unionByName(df.where("id < 3"))  # the SQL's join repeats pairs of repeated ids
    met = vectors.cosine_pairs(twice, 0.3, block=32, cell_rows=20)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    many = lambda i: 1 + (i < 3)
    want = {(i, j): many(i) * many(j) for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(cosines(m) >= 0.3, 1))), strict=True)}
    assert {(r.src, r.dst): r["count"] for r in met.groupBy("src", "dst").count().collect()} == want
    to = cells.cells(df, 20)
    blocks = [r.id for r in cells.among(to, 0.3, 32).select("id").collect()]
    assert len(blocks) > 10 and sorted(np.concatenate([np.frombuffer(x, np.int64) for x in blocks]).tolist()) == list(range(len(m)))


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.1])
def test_clusters_after_new_faces_in_many_blocks(spark, blobs, threshold):
    m, df = blobs
    label = cells.joined_labels(np.arange(len(m)), *np.nonzero(np.triu(cosines(m) >= threshold, 1)))
    old = df.where("id % 10 <> 3")
    first = vectors.extended_clusters(old, old, spark.createDataFrame([], "node long, component long"), threshold, block=32, cell_rows=20)
    got = vectors.extended_clusters(df, df.where("id % 10 = 3"), first, threshold, block=32, cell_rows=20)
    assert {r.node: r.component for r in got.collect()} == dict(enumerate(label.tolist()))


def test_links_of_dense_vectors_do_not_grow_with_the_pairs_of_blocks(spark):
    rng = np.random.default_rng(5)
    near = [(i, (np.eye(8)[0] + rng.normal(0, 0.01, 8)).tolist()) for i in range(400)]
    to = cells.cells(spark.createDataFrame(near, "id long, embedding array<double>"), 20)
    left, right = cells.linked(to, to.rows, None, 0.5, 10)
    n = left.count()
    links = vectors._forest(left, right, to, np.float64, 0.5).count()
    assert n >= 40 and links <= 400 + 64 * n  # each block's own links once, then at most a link a block and task


def test_searches_of_nothing(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert vectors.cosine_pairs(none, 0.5).isEmpty() and vectors.cluster(none, 0.5).isEmpty()
    assert vectors.top_k_batch(none, none.withColumnRenamed("id", "query_id"), 3).isEmpty()
    assert hamming.near_values(spark.createDataFrame([], "scope long, h long"), 10).isEmpty()
    assert hamming.near_values(spark.createDataFrame([(1, 5)], "scope long, h long"), 10).isEmpty()


def test_values_do_not_travel_to_their_masks(spark, values, monkeypatch):
    """Under many masks the pairs' plan has no shuffle, and dense values' pairs come by their lesser node."""
    monkeypatch.setattr(hamming, "limits", lambda r: ((1 << 40, "halves"),))
    monkeypatch.setattr(hamming, "CAP", 2000)
    dense = (values[0] & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64)
    v = np.unique(np.concatenate([values[:200], dense]))
    df = spark.createDataFrame([(3, int(x.view(np.int64)), i) for i, x in enumerate(v)], "scope long, h long, node long")
    met = hamming.near_pairs(df, 10)
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    got = [(r.a, r.b) for r in met.collect()]
    place = {int(x): i for i, x in enumerate(v)}
    assert sorted(got) == sorted(tuple(sorted((place[a], place[b]))) for a, b in brute(v, 10))
    assert sum(x[0] != y[0] for x, y in zip(got, got[1:])) < len(got) / 4  # by steps along the runs nearly all would differ
