"""N-gram Jaccard join by prefix filters under several global orders of tokens, confirmed on full sets.

A document's set: its distinct k-word shingles (lower-cased A-Z; words between white space); with fewer words the whole
sequence is one. Under any order of all tokens, two sets whose similarity reaches the threshold share a token among the first
n - ceil(threshold * n) + 1 of each, and l among l - 1 more of each. ORDERS orders are used: all put rare tokens first, by the class (power of two) of how
often a token's slot of a table of 2**BITS counters is met over all documents, and each puts tokens of a class in another
random order. A pair is compared only if its prefixes meet under every order: in up to MORE + 1 tokens of the first, and in as many
tokens of each other one as half of what the sets may lack. The counters' size is fixed, and what they say changes how many
candidates there are, never which pairs are found.

Equal sets are one node. Nodes meet in buckets, the tokens of the first order's prefixes; no bucket is listed pair by pair but
those of at most SMALL_BUCKET nodes:
1. every node is compared with its bucket's most central node, after sizes and the other orders; links make components;
2. of small buckets that still hold several components, pairs that share as many tokens as they must are compared;
3. of larger ones, only nodes with a partner in another component by all orders stay, found in blocks of BLOCK_ROWS by matrix
   products of incidences; these are compared in blocks, exactly, by products of incidences of full sets: a cluster of nodes
   that share buckets as one group, one of more than CLUSTER_ROWS nodes bucket by bucket. A link to each other component is
   enough.

Tokens are 64-bit hashes; a node is known by 128 bits of its set.

Defined results: null or wordless text has an empty set and is linked with nothing; rows are judged each on its own text, so
rows that share an id may have different components; a null id has a null component unless its set links it with an id, and
is never one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.graph import components
from lumenlake.llm.near_dup import _sets
from lumenlake.llm.textblocks import LOWER, SPACED, U64, blocks, mix, ngrams
from lumenlake.shared import arrow_rows, materialize, release

ORDERS, BITS = 3, 20
#: bits of the bitmaps that spare rows without a partner
SEEN = 23
#: tokens that the first order's prefixes are longer than those that share one token, at most
MORE = 3
#: columns of the orders but the first
FILTERS = tuple(f"{c}{i}" for i in range(1, ORDERS) for c in "lp")
#: counters to a row on their way to the driver
PIECE = 4096
BLOCK_ROWS, CLUSTER_ROWS = 512, 4096
#: buckets of more nodes are looked through in blocks
SMALL_BUCKET = 32
#: columns of an incidence matrix at once
COLUMNS = 4096
#: rows that Python gets at once
AT_ONCE = 512


def token_classes(docs: DataFrame, k: int, text_col: str = "text") -> np.ndarray:
    """The class of every slot: how many bits the number of its shingles over all documents has; a task counts to 65,535."""

    def count(batches):
        held = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                grams, at = ngrams(*b.word_hashes(SPACED, LOWER), k)
                held += np.bincount((grams[at] >> U64(64 - BITS)).astype(np.int64), minlength=len(held))
        pieces = held.reshape(-1, PIECE)
        some = np.flatnonzero(pieces.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([np.minimum(pieces[i], 65535).astype(np.uint16).tobytes() for i in some], pa.binary())], ["piece", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}  # at most 2**BITS counters
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(counts.as_buffer(), np.uint16).astype(np.int64)
                held[piece] = held[piece] + own if piece in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["piece", "counts"])

    shape = "piece long, counts binary"
    got = docs.select(F.col(text_col).alias("text")).mapInArrow(count, shape).repartition("piece").mapInArrow(add, shape).toArrow()
    out = np.zeros((1 << BITS) // PIECE * PIECE, np.int64).reshape(-1, PIECE)
    for piece, counts in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[piece] = np.frombuffer(counts, np.int64)
    return np.ceil(np.log2(out.ravel() + 1)).astype(np.uint8)


def _prefix(values: np.ndarray, row: np.ndarray, starts: np.ndarray, size: np.ndarray, order: int, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of every row's prefix under an order, how many each has, and how many of them a set in reach must share. values:
    rows' sorted distinct tokens in turn. The first order's prefixes are the shortest ones, of which one token is shared."""
    rare = classes[(values >> U64(64 - BITS)).astype(np.int64)].astype(U64)
    key = (rare << U64(56)) | (mix(values ^ mix(np.array([order + 1], U64))[0]) >> U64(8))
    by = np.lexsort((key, row))
    spare = size - (-(-percent * size // 100))  # tokens that a set in reach may lack
    least = 1 + (spare // 2 if order else np.minimum(spare // 2, MORE))
    length = np.where(size > 0, spare + least, 0)
    rank = np.arange(len(by)) - np.repeat(starts, size)
    return values[by[rank < length[row[by]]]], length, least


def prefixes(docs: DataFrame, classes, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (128 bits of the text), n_shingles, node (128 bits of the set; null if empty), p0 (tokens of the
    first order's prefix), l0 (how many of them a set in reach shares) and FILTERS: the same of the other orders, as the
    tokens' low 16 bits. classes: broadcast."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for first, rows, values, edges in _sets(batch.column(2), k):
                size = np.diff(edges)
                row = np.repeat(np.arange(rows), size)
                sums = np.zeros((rows, 2), U64)
                some = np.flatnonzero(size)
                if len(some):
                    for j, salt in enumerate((U64(0), U64(0x5851F42D4C957F2D))):
                        sums[some, j] = mix(np.add.reduceat(mix(values ^ salt), edges[some]) ^ size[some].astype(U64))
                node = pa.array([sums[i].tobytes() if size[i] else None for i in range(rows)], pa.binary())
                lists = []
                for order in range(ORDERS):
                    tokens, length, least = _prefix(values, row, edges[:-1], size, order, classes.value, percent)
                    edge, own = np.concatenate([[0], np.cumsum(length)]), np.repeat(np.arange(rows), length)
                    if order:
                        tokens = tokens.astype(np.uint16)
                        distinct = np.unique(own << 16 | tokens)  # equal halves of tokens may count once
                        least = np.maximum(least - (length - np.bincount(distinct >> 16, minlength=rows)), 1)
                    lists.append(pa.array(least.astype(np.int32)))
                    lists.append(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(tokens.view(np.int16 if order else np.int64))))
                kept = [batch.column(j).slice(first, rows) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(size.astype(np.int64)), node, *lists], ["doc_id", "row", "n_shingles", "node", "l0", "p0", *FILTERS])

    own = docs.select(F.col(id_col).alias("doc_id"), _row(text_col).alias("row"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, row binary, n_shingles long, node binary, l0 int, p0 array<long>, " + ", ".join(f"l{i} int, p{i} array<short>" for i in range(1, ORDERS)))


def _row(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _bitmap(hashes: DataFrame):
    """A broadcast bitmap of 2**SEEN bits of a column of longs: its size is fixed, and it only spares rows without a partner."""
    slot = F.shiftrightunsigned(hashes.columns[0], 64 - SEEN)
    marks = hashes.select(slot.alias("slot")).select(F.shiftright("slot", 3).cast("int").alias("byte"), F.expr("shiftleft(1, int(slot & 7))").alias("bit"))
    got = marks.groupBy("byte").agg(F.bit_or("bit").cast("short").alias("bits")).toArrow()  # at most 2**(SEEN - 3) rows
    out = np.zeros(1 << (SEEN - 3), np.uint8)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def _in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.view(U64) >> U64(64 - SEEN)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _shared_tokens(nodes: DataFrame) -> DataFrame:
    """token, node, n, size: the tokens of the first order's prefixes that size nodes, two or more, have."""
    tokens = nodes.select("node", "n", "p0")
    shared = materialize(tokens.select(F.explode("p0").alias("token")).groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "shared-tokens")
    seen = _bitmap(shared.select("token"))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            token = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            ok = _in_bitmap(seen.value, token)
            at = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(token[ok])], ["node", "n", "token"])

    out = materialize(tokens.mapInArrow(run, "node long, n long, token long").join(shared, "token"), "buckets")
    seen.destroy()
    release(shared)
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """node, text. wanted: node, row; rows of other texts are left out before the shuffle."""
    seen = _bitmap(wanted.select(F.xxhash64("row").alias("h")))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in_bitmap(seen.value, batch.column(0).to_numpy(zero_copy_only=False)))).select([1, 2])

    rows = docs.select(_row(text_col).alias("row"), F.col(text_col).alias("text"))
    rows = rows.select(F.xxhash64("row").alias("h"), "row", "text").mapInArrow(run, "row binary, text string")
    out = materialize(rows.join(wanted, "row").dropDuplicates(["node"]).select("node", "text"), "texts")
    seen.destroy()
    return out


def _confirm(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs: a, b, text, text2; the pairs that hold, on full sets."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [values[edges[i] : edges[i + 1]] for _, rows, values, edges in _sets(column, k) for i in range(rows)]

    def run(batches):
        for batch in batches:
            met = list(zip(sets(batch.column(2)), sets(batch.column(3)), strict=True))
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in met], np.int64)
            n = np.array([len(x) + len(y) for x, y in met], np.int64)
            yield batch.select([0, 1]).filter(pa.array(100 * common >= percent * (n - common), pa.bool_()))

    return pairs.select("a", "b", "text", "text2").mapInArrow(run, "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each left set shares with each right one, by products of incidences over the tokens of both sides."""
    sides, names = [], []
    for sets in (left, right):
        values = np.concatenate(sets) if sets else np.zeros(0, U64)
        sides.append((values, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
        names.append(np.unique(values))
    both = np.intersect1d(*names, assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24 shared tokens
    at = []
    for values, row in sides:
        i = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = both[i] == values if len(both) else np.zeros(len(values), bool)
        i, row = i[hit], row[hit]
        order = np.argsort(i, kind="stable")
        at.append((i[order], row[order]))
    for lo in range(0, len(both), COLUMNS):
        hi = min(lo + COLUMNS, len(both))
        parts = []
        for (i, row), n in zip(at, (len(left), len(right)), strict=True):
            s = slice(*np.searchsorted(i, [lo, hi]))
            m = np.zeros((n, hi - lo), np.float32)
            m[row[s], i[s] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _may_link(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n1, n2) * 100 >= np.maximum(n1, n2) * percent


def _shares(least1: Column, least2: Column, tokens1: Column, tokens2: Column) -> Column:
    return F.size(F.array_intersect(tokens1, tokens2)) >= F.least(least1, least2)


def _few(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a < b: pairs of different components that share as many of the first order's tokens as they must, by buckets of at most
    SMALL_BUCKET nodes, so that a row meets no more than so many. rows: token, node, n, c; nodes: node, l0."""
    one = rows.select("token", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("c").alias("c1"))
    two = rows.select("token", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    met = one.join(two, "token").where((F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2")) & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("shared"))
    least = lambda c, name: nodes.select(F.col("node").alias(c), F.col("l0").alias(name))
    return counted.join(least("a", "la"), "a").join(least("b", "lb"), "b").where(F.col("shared") >= F.least("la", "lb")).select("a", "b")


def _partnered(rows: DataFrame, percent: int) -> DataFrame:
    """token, node: nodes that have a partner of another component in their bucket, by size and all other orders, block by
    block. rows: token, node, n, c, size and FILTERS."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        ok = _may_link(left["n"].to_numpy()[:, None], right["n"].to_numpy()[None], percent) & (left["c"].to_numpy()[:, None] != right["c"].to_numpy()[None])
        for i in range(1, ORDERS):
            least = np.minimum(left[f"l{i}"].to_numpy()[:, None], right[f"l{i}"].to_numpy()[None])
            ok &= overlaps([np.unique(x) for x in left[f"p{i}"]], [np.unique(x) for x in right[f"p{i}"]]) >= least
        stay = np.unique(np.concatenate([left["node"].to_numpy()[ok.any(1)], right["node"].to_numpy()[ok.any(0)]]))
        return pd.DataFrame({"token": np.full(len(stay), key[0]), "node": stay})

    blocks = _in_blocks(rows.withColumn("others", F.col("size")), F.lit(True))
    return blocks.select("token", "lb", "rb", "side", "node", "n", "c", *FILTERS).groupBy("token", "lb", "rb").applyInPandas(run, "token long, node long").distinct()


def _in_blocks(rows: DataFrame, on_right: Column) -> DataFrame:
    """rows (size and others: how many of a group there are, and how many of them on the right) under every pair of blocks,
    lb of the left side (0) and rb of the right (1), that they take part in."""
    blocks_of = lambda c: F.ceil(F.col(c) / BLOCK_ROWS)
    spread = rows.withColumn("nl", blocks_of("size")).withColumn("nr", blocks_of("others")).withColumn("h", F.xxhash64("node"))
    zero = F.lit(0).cast("long")
    left = spread.withColumn("lb", F.pmod("h", "nl")).withColumn("rb", F.explode(F.sequence(zero, F.col("nr") - 1))).withColumn("side", F.lit(0))
    right = spread.where(on_right).withColumn("rb", F.pmod("h", "nr")).withColumn("lb", F.explode(F.sequence(zero, F.col("nl") - 1))).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("nl", "nr", "h")


def _across(groups: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between nodes of different components of a group, one for a node and a component. groups: kind, key, lb,
    rb, side, node, n, c, text."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        left, right = f[f["side"] == 0], f[f["side"] == 1]
        sets = [[v[e[i] : e[i + 1]] for _, rows, v, e in _sets(pa.array(x["text"], pa.string()), k) for i in range(rows)] for x in (left, right)]
        common = overlaps(*sets)
        n1, n2 = left["n"].to_numpy()[:, None], right["n"].to_numpy()[None]
        c1, c2 = left["c"].to_numpy(), right["c"].to_numpy()
        a, b = np.nonzero((100 * common >= percent * (n1 + n2 - common)) & (c1[:, None] != c2[None]))
        found = pd.DataFrame({"a": left["node"].to_numpy()[a], "b": right["node"].to_numpy()[b], "c": c1[a], "i": b})
        return found.drop_duplicates(["i", "c"])[["a", "b"]]

    return groups.groupBy("kind", "key", "lb", "rb").applyInPandas(run, "a long, b long")


def _under_all(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under every other order."""
    side = lambda c: nodes.select(F.col("node").alias(c), *[F.col(p).alias(f"{p}{c}") for p in FILTERS])
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    for i in range(1, ORDERS):
        out = out.where(_shares(*[F.col(f"{c}{i}{s}") for c in "lp" for s in "ab"]))
    return out.select("a", "b")


def ngram_join(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id reachable over links of similarity >= percent / 100."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(token_classes(docs, k, text_col))
    made = materialize(prefixes(docs, classes, k, percent, id_col, text_col), "prefixes")
    classes.destroy()
    nodes = made.where("node is not null").select(F.col("node").alias("set"), "row", F.col("n_shingles").alias("n"), "l0", "p0", *FILTERS).dropDuplicates(["set"])
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # short names, fixed once written
    all_docs = materialize(made.select("doc_id", "n_shingles", F.col("node").alias("set")), "documents")
    release(made)
    buckets = _shared_tokens(nodes)

    # every node against its bucket's most central one
    central = buckets.groupBy("node").agg(F.sum("size").alias("central"))
    pivots = buckets.join(central, "node").groupBy("token").agg(F.max(F.struct("central", "node", "n")).alias("x")).select("token", F.col("x.node").alias("b"), F.col("x.n").alias("n2"))
    met = buckets.join(pivots, "token").where(F.col("node") != F.col("b"))
    met = met.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent).select(F.col("node").alias("a"), "b").distinct()
    likely = materialize(_under_all(met, nodes), "likely")

    def held(ids: DataFrame) -> DataFrame:
        return _texts_of(docs, nodes.select("node", "row").join(ids.distinct(), "node", "left_semi"), text_col)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        texts = held(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        with arrow_rows(spark, AT_ONCE):
            out = materialize(_confirm(pairs.join(texts.withColumnsRenamed({"node": "a"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "text2"}), "b"), k, percent), name)
        release(texts)
        return out

    links = confirmed(likely, "links")
    label = components(links, "a", "b")

    # buckets that hold several components still; of two nodes, both have been compared
    rows = buckets.where("size > 2").join(label.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    mixed = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token")
    rows = materialize(rows.join(mixed, "token").select("token", "node", "n", "c", "size"), "mixed")
    done = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    small, large = rows.where(F.col("size") <= SMALL_BUCKET), rows.where(F.col("size") > SMALL_BUCKET)
    few = materialize(_under_all(_few(small, nodes, percent).join(done, ["a", "b"], "left_anti"), nodes), "few")
    few_links = confirmed(few, "few-links")
    release(buckets, likely, label, few)
    with arrow_rows(spark, AT_ONCE):
        stay = materialize(_partnered(large.join(nodes.select("node", *FILTERS), "node"), percent).join(rows.select("token", "node", "n", "c"), ["token", "node"]), "partnered")
    least = stay.groupBy("token").agg(F.min("node").alias("least"))
    cluster = components(stay.join(least, "token").select("node", "least"), "node", "least")
    sizes = cluster.groupBy("component").count()
    of = stay.join(cluster, "node").join(sizes, "component")
    whole = of.where(F.col("count") <= cluster_rows).select(F.lit(0).alias("kind"), F.col("component").alias("key"), "node", "n", "c").distinct()
    apart = of.where(F.col("count") > cluster_rows).select(F.lit(1).alias("kind"), F.col("token").alias("key"), "node", "n", "c")
    groups = materialize(whole.unionByName(apart), "groups")
    per = groups.groupBy("kind", "key", "c").agg(F.count("*").alias("m")).groupBy("kind", "key").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("size"))
    per = per.select("kind", "key", "size", F.col("x.c").alias("main"), (F.col("size") - F.col("x.m")).alias("others")).where("others > 0")
    spread = _in_blocks(groups.join(per, ["kind", "key"]), F.col("c") != F.col("main"))
    texts = held(groups.select("node"))
    with arrow_rows(spark, AT_ONCE):
        more = materialize(_across(spread.select("kind", "key", "lb", "rb", "side", "node", "n", "c").join(texts, "node"), k, percent), "more-links")
    release(texts, rows, stay, cluster, groups)
    final = components(links.unionByName(few_links).unionByName(more), "a", "b")

    of_set = nodes.select("set", "node").join(final, "node", "left").select("set", F.coalesce("component", "node").alias("component"))
    named = all_docs.join(of_set, "set", "left")
    ids = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = materialize(named.join(ids, "component", "left").select("doc_id", "n_shingles", own.alias("component_id")), "joined")
    release(all_docs, nodes, links, few_links, more, final)
    return out
