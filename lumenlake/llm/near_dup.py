"""Near-duplicate groups by SetSketch registers, a joint likelihood estimate and exact confirmation.

A document's set is its distinct k-word shingles (lower-cased A-Z; words between white space); with fewer
words the whole sequence is one shingle. The sketch keeps REGISTERS registers K = floor(1 - log_b h), h the
least of the set's exponential hashes (rate RATE): truncated to 16 bits, mergeable by maximum and equal with a
probability close to the Jaccard similarity (Ertl, VLDB 2021). A band is WIDTH registers, compared by value.

Work per bucket of equal band values is linear in its size: copies with equal sets are one node from the
start, every node is compared with the bucket's most central node, and only nodes that a later pass finds in
another component than the rest are compared with all others, in blocks. No candidate is dropped uncompared:
a pair is given up only if the likelihood ratio puts it CUT standard deviations under the threshold.

Defined results: null or wordless text has an empty set, is linked with nothing and is kept; rows that share
an id are one node; a row with a null id has a null component and is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.graph import components
from lumenlake.llm.textblocks import LOWER, SMALL_BLOCK, SPACED, U64, blocks, bounds, mix, ngrams
from lumenlake.shared import arrow_rows, materialize, release

REGISTERS, WIDTH, BASE, RATE = 128, 4, 1.001, 20.0
CUT = 6.0
BLOCK_ROWS = 512
#: rows with texts, registers or whole sets that Python gets at once
AT_ONCE = 512
#: nodes that share buckets with one another, up to so many, are compared as one group; more, bucket by bucket
CLUSTER_ROWS = 4096
MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) | U64(1)


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block: first row, rows, all rows' sorted distinct shingle hashes in turn, and where each row's begin."""
    for b in blocks(column, SMALL_BLOCK):
        h, row = b.word_hashes(SPACED, LOWER)
        grams, at = ngrams(h, row, k)
        grams, grow = grams[at], row[at]
        word, gram = bounds(row, b.rows), bounds(grow, b.rows)
        out = []
        for i in range(b.rows):
            if gram[i] < gram[i + 1]:
                out.append(np.unique(grams[gram[i] : gram[i + 1]]))
            elif word[i] < word[i + 1]:
                n = word[i + 1] - word[i]
                out.append(ngrams(h[word[i] : word[i + 1]], row[word[i] : word[i + 1]], n)[0] ^ U64(n))
            else:
                out.append(np.zeros(0, U64))
        yield b.first, b.rows, np.concatenate(out), np.cumsum([0, *map(len, out)])


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of the sets that begin at starts (none empty): a row of REGISTERS each."""
    out, work = np.empty((len(starts), REGISTERS), U64), np.empty_like(values)
    for i, m in enumerate(MULTIPLIERS):
        out[:, i] = np.minimum.reduceat(np.multiply(values, m, out=work), starts)
    h = -np.log1p(-np.minimum((out.astype(np.float64) + 1) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, 65535).astype(np.uint16)


def sketches(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fp (two words that identify the set) and bands (the registers, WIDTH to a long)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            size, fp, bands = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.zeros((n, REGISTERS // WIDTH), np.int64)
            for first, rows, values, starts in _sets(batch.column(1), k):
                size[first : first + rows] = np.diff(starts)
                some = np.flatnonzero(np.diff(starts))
                if len(some):
                    at = starts[some]
                    bands[first + some] = registers(values, at).view(np.int64)
                    for j, salt in enumerate((U64(0), U64(0x5851F42D4C957F2D))):
                        fp[first + some, j] = np.add.reduceat(mix(values ^ salt), at).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), lists], ["doc_id", "n_shingles", "fp1", "fp2", "bands"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, n_shingles long, fp1 long, fp2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its sorted distinct shingle hashes, eight bytes each."""

    def run(batches):
        for batch in batches:
            for first, rows, values, starts in _sets(batch.column(1), k):
                sets = pa.array([values[starts[i] : starts[i + 1]].tobytes() for i in range(rows)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), sets], ["doc_id", "shingles"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {_kind(docs, id_col)}, shingles binary")


def _log_likelihood(j: np.ndarray, up: np.ndarray, down: np.ndarray, same: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Of similarity j, given how many registers of the first set are above, below and equal; share: its part of n1 + n2."""
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(share - (1 - share) * j), p((1 - share) - share * j)
    tiny = 1e-12
    return up * np.log(np.maximum(more, tiny)) + down * np.log(np.maximum(less, tiny)) + same * np.log(np.maximum(1 - more - less, tiny))


def plausible(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs whose registers do not rule out the threshold: the likelihood at the best estimate of the similarity
    against that at the threshold, CUT standard deviations. a and b: registers, a row a pair."""
    same = (a == b).sum(1).astype(np.float64)
    up = (a > b).sum(1).astype(np.float64)
    down = REGISTERS - same - up
    share = n1 / (n1 + n2)
    top = np.minimum(share / (1 - share), (1 - share) / share)
    grid = np.linspace(0, 1, 41)
    like = np.stack([_log_likelihood(top * g, up, down, same, share) for g in grid])
    best = like.argmax(0)
    at = _log_likelihood(np.minimum(threshold, top), up, down, same, share)
    return (top >= threshold - 1e-9) & ((top * grid[best] >= threshold) | (like.max(0) - at <= CUT * CUT / 2))


def _confirmed(a: bytes | pa.Buffer, b: bytes | pa.Buffer, percent: int) -> bool:
    x, y = np.frombuffer(a, U64), np.frombuffer(b, U64)
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    def run(frames):
        for f in frames:
            if len(f):
                a, b = (np.stack(f[c].to_numpy()).astype(np.int64).view(np.uint16) for c in ("bands", "bands2"))
                f = f[plausible(a, b, f["n"].to_numpy(float), f["n2"].to_numpy(float), percent / 100)]
            yield f[["a", "b"]]

    return pairs.mapInPandas(run, "a {0}, b {0}".format(_kind(pairs, "a")))


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b, shingles, shingles2; the pairs that hold."""

    def run(batches):
        for batch in batches:
            keep = pa.array([_confirmed(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    return pairs.select("a", "b", "shingles", "shingles2").mapInArrow(run, "a {0}, b {0}".format(_kind(pairs, "a")))


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that share a bucket and are in different components, in blocks of a bucket's members or of a
    cluster's (band -1); one of each component for a node is enough. mixed: band, key, lb, rb, side, node, component,
    n, bands, shingles."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        band = int(key[0])
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        out: list[tuple] = []
        if len(left) and len(right):
            lb, rb = (np.stack(x["bands"].to_numpy()).astype(np.int64) for x in (left, right))
            ln, ls, lc, lid = left["n"].to_numpy(float), left["shingles"].to_numpy(), left["component"].to_numpy(), left["node"].to_numpy()
            for i, (node, comp, n, own) in enumerate(zip(right["node"], right["component"], right["n"], right["shingles"], strict=True)):
                equal = lb == rb[i]
                here = equal.any(1) if band < 0 else equal.argmax(1) == band  # else an earlier band compares them
                at = np.flatnonzero((lc != comp) & here & (lid != node) & (np.minimum(ln, n) * 100 >= np.maximum(ln, n) * percent))
                at = at[plausible(lb[at].view(np.uint16), np.broadcast_to(rb[i], (len(at), lb.shape[1])).copy().view(np.uint16), ln[at], np.full(len(at), float(n)), percent / 100)] if len(at) else at
                found = set()
                for x in at:
                    if lc[x] not in found and _confirmed(ls[x], own, percent):
                        found.add(lc[x])
                        out.append((node, lid[x]))
        return pd.DataFrame(out, columns=["a", "b"])

    return mixed.groupBy("band", "key", "lb", "rb").applyInPandas(run, "a {0}, b {0}".format(_kind(mixed, "node")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """doc_id (of any type with an order), n_shingles, component_id (the least id reachable over links of similarity >= percent / 100), kept."""
    with arrow_rows(docs.sparkSession, AT_ONCE):
        all_docs = materialize(sketches(docs, k, id_col, text_col), "sketches")
    some = all_docs.where("n_shingles > 0 and doc_id is not null")
    # copies with equal sets are one node, named by its least id
    sets = materialize(some.groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("fp1", "fp2", F.col("n_shingles").alias("n"), F.col("x.doc_id").alias("node"), F.col("x.bands").alias("bands")), "nodes")
    nodes = sets.select("node", "n", "bands")
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    rows = buckets = materialize(rows.join(sizes, ["band", "key"]), "buckets")
    central = rows.groupBy("node").agg(F.sum("size").alias("central"))
    pivots = rows.join(central, "node").groupBy("band", "key").agg(F.max(F.struct("central", F.col("node").alias("pivot"))).alias("x")).select("band", "key", F.col("x.pivot").alias("pivot"))
    pairs = rows.join(pivots, ["band", "key"]).where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    one, two = nodes.toDF("a", "n", "bands"), nodes.toDF("b", "n2", "bands2")
    sized = pairs.join(one, "a").join(two, "b").where("least(n, n2) * 100 >= greatest(n, n2) * %d" % percent)
    likely = materialize(_likely(sized, percent), "likely")

    def of(ids: DataFrame) -> DataFrame:
        """Sets of the nodes that take part, from whole texts."""
        own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return shingle_sets(own.join(ids.distinct().withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), k).withColumnRenamed("doc_id", "node").dropDuplicates(["node"])

    held = of(likely.select(F.explode(F.array("a", "b")).alias("node")))
    with arrow_rows(docs.sparkSession, AT_ONCE):
        links = materialize(_confirm(likely.join(held.toDF("a", "shingles"), "a").join(held.toDF("b", "shingles2"), "b"), percent), "links")
    label = components(links, "a", "b")

    # nodes of a bucket that are still in different components
    rows = rows.join(label.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    per = rows.groupBy("band", "key").agg(F.count("*").alias("members"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band", "key")
    rows = mixed = materialize(rows.join(per, ["band", "key"]).select("band", "key", "node", "n", "c"), "mixed")
    release(buckets, likely)
    first = rows.groupBy("band", "key").agg(F.min("node").alias("least"))
    found = components(rows.join(first, ["band", "key"]).select("node", "least"), "node", "least")
    cluster = found.withColumnRenamed("component", "cluster")
    small = cluster.groupBy("cluster").count().where(F.col("count") <= cluster_rows).select("cluster")
    whole = cluster.join(small, "cluster").join(rows.select("node", "n", "c").distinct(), "node").select(F.lit(-1).alias("band"), F.xxhash64("cluster").alias("key"), "node", "n", "c")
    large = rows.join(cluster.join(small, "cluster", "left_anti"), "node").select("band", "key", "node", "n", "c")
    rows = groups = materialize(whole.unionByName(large), "groups")
    by_c = rows.groupBy("band", "key", "c").agg(F.count("*").alias("m"))
    main = by_c.groupBy("band", "key").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("members")).select("band", "key", F.col("x.c").alias("main"), "members", (F.col("members") - F.col("x.m")).alias("others"))
    rows = rows.join(main, ["band", "key"])
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK_ROWS)
    spread = rows.withColumn("nl", blocks_of("members")).withColumn("nr", blocks_of("others")).withColumn("h", F.xxhash64("node"))
    left = spread.withColumn("lb", F.pmod("h", "nl")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("side", F.lit(0))
    right = spread.where("c <> main").withColumn("rb", F.pmod("h", "nr")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("nl") - 1))).withColumn("side", F.lit(1))
    take = [*[F.col(x).cast("long").alias(x) for x in ("band", "key", "lb", "rb", "side", "n")], "node", F.col("c").alias("component")]
    both = left.select(*take).unionByName(right.select(*take))
    held = of(rows.select("node"))
    with arrow_rows(docs.sparkSession, AT_ONCE):
        more = materialize(_across(both.join(nodes.select("node", "bands"), "node").join(held, "node"), percent), "more-links")
    final = components(links.unionByName(more), "a", "b")
    named = sets.select("fp1", "fp2", F.col("n").alias("n_shingles"), "node").join(final.withColumnRenamed("component", "c"), "node", "left").select("fp1", "fp2", "n_shingles", F.coalesce("c", "node").alias("component_id"))
    out = all_docs.drop("bands").join(named, ["fp1", "fp2", "n_shingles"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    out = materialize(out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups-of-copies")
    release(all_docs, sets, links, label, groups, found, mixed, more, final)
    return out
