"""Ranked lexical search: term-at-a-time with limited accumulators, over all documents.

Queries are items. A document's score for an item sums, over the item's terms, weight * saturated frequency, all in integers:
w = floor(1000 * ln((2N + 2) / (2 df + 1))), tf part (10**9 tf) div (1000 tf + 20 m), m = 100 - LENGTH + LENGTH n N div L.

One pass over the texts writes an index: a row a document with its number of terms and, of the items' terms, which it holds
how often. A second gives each term its df and the largest tf part it has anywhere, so that w times that is its bound.
Then a task takes a batch of documents as inverted lists and goes through an item's terms, the rarest first. Accumulators are
created while the bounds of the terms to come could still lift a new document to the floor, the kth score known so far; after
that, only the survivors are updated, exactly, and those that can no longer reach the floor are let go. The floor comes from
a first round in which an item's rarest terms alone, enough of them to meet SEEDS documents, create accumulators: the kth of
their exact scores over all documents. It bounds the final kth from below, so the second round gives the exact answer, and
few rows besides it leave the tasks. Spark takes the best k of every task before it shuffles, and of all of them after.

Items come in blocks of about BLOCK_TERMS terms, so what is broadcast has a fixed size however many items there are; each
block has its own index. Terms are known by 64-bit hashes.

Defined results: a null text has no terms; a document without terms counts for nothing and is never returned; an item
without terms, or with none that a document holds, gives no rows; equal item rows are one, and texts that share an item id
are ranked each on their own; documents that share an id are ranked each, next to one another on equal scores; a null id
comes last among equals; a term that nearly all documents hold weighs 0, and a score of 0 is no hit; other columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import ALNUM, LOWER, U64, blocks, mix
from lumenlake.shared import materialize, release

K, LENGTH = 50, 50
#: an item's rarest terms make the first floor, until they meet so many documents
SEEDS = 20 * K
#: terms of the items that are looked up at once
BLOCK_TERMS = 500_000


def tf_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def length_part(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    return 100 - LENGTH + (LENGTH * n * docs) // terms


def item_terms(items: DataFrame) -> DataFrame:
    """items: item (a key), text. item, h for each of its distinct terms."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, row = b.word_hashes(ALNUM, LOWER)
                _, at = np.unique(h ^ mix(row.astype(U64) + U64(1)), return_index=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b.first + row[at])), pa.array(h[at].view(np.int64))], ["item", "h"])

    return items.select("item", "text").mapInArrow(run, "item binary, h long")


def index(docs: DataFrame, vocabulary) -> DataFrame:
    """docs: doc_id, text. doc_id, n and, for its terms in the broadcast sorted vocabulary, places in it and frequencies."""

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, row = b.word_hashes(ALNUM, LOWER)
                n = np.bincount(row, minlength=b.rows).astype(np.int64) if len(row) else np.zeros(b.rows, np.int64)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                pair, tf = np.unique(row[hit] * len(known) + at[hit], return_counts=True)
                own, term = pair // max(len(known), 1), pair % max(len(known), 1)
                edge = pa.array(np.searchsorted(own, np.arange(b.rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, terms array<int>, tfs array<int>")


def _postings(batch: pa.RecordBatch, at: int, docs: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and tf part of all pairs of a batch whose columns at, at + 1, at + 2 are n, terms and tfs."""
    n, lists, tfs = (batch.column(at + i) for i in range(3))
    term = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    m = length_part(n.to_numpy(zero_copy_only=False), docs, terms)
    return term, row, tf_part(tfs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), m[row])


def term_bounds(indexed: DataFrame, size: int, docs: int, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """df and the largest tf part of every term. Tasks send a row a term that they meet."""

    def run(batches):
        df, most = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            term, _, part = _postings(batch, 0, docs, terms)
            df += np.bincount(term, minlength=size)
            np.maximum.at(most, term, part)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(most[at])], ["term", "df", "most"])

    got = indexed.select("n", "terms", "tfs").mapInArrow(run, "term long, df long, most long").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most")).toPandas()
    out = np.zeros((2, size), np.int64)
    out[:, got["term"].to_numpy(np.int64)] = got["df"], got["most"]
    return out[0], out[1]


def accumulate(lists, order: np.ndarray, weights: np.ndarray, rest: np.ndarray, creating: int, floor: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and exact scores of the documents that reach floor. lists(term): its rows, rising, and their tf parts; order: the
    item's terms, the rarest first; rest[j]: the bound of all terms from the jth on. The first creating terms may create
    accumulators; creating < 0: those while rest could reach the floor. held: zeros, a row each, and zeros again afterwards."""
    n = creating if creating >= 0 else int(np.searchsorted(-rest[:-1], -floor, "right"))
    met = []
    for j in range(min(n, len(order))):
        own, part = lists(order[j])
        held[own] += weights[j] * part
        met.append(own)
    rows = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    score = held[rows]
    held[rows] = 0
    for j in range(len(met), len(order)):
        alive = score + rest[j] >= floor
        rows, score = rows[alive], score[alive]
        if not len(rows):
            break
        own, part = lists(order[j])
        if len(own):
            at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
            score = score + np.where(own[at] == rows, weights[j] * part[at], 0)
    alive = score >= floor
    return rows[alive], score[alive]


def _round(indexed: DataFrame, plan, k: int) -> DataFrame:
    """item (a place in the block), doc_id, score: of each batch the best k documents of every item that reach its floor."""
    kind = dict(indexed.dtypes)["doc_id"]

    def run(batches):
        orders, weights, rests, creating, floors, docs, terms, size = plan.value
        for batch in batches:
            term, row, part = _postings(batch, 1, docs, terms)
            by = np.argsort(term, kind="stable")
            term, row, part = term[by], row[by], part[by]
            edge = np.searchsorted(term, np.arange(size + 1))
            lists = lambda t: (row[edge[t] : edge[t + 1]], part[edge[t] : edge[t + 1]])
            found, held = [], np.zeros(batch.num_rows, np.int64)
            for i, order in enumerate(orders):
                rows, score = accumulate(lists, order, weights[i], rests[i], creating[i], max(1, floors[i]), held)
                if len(rows):
                    found.append((np.full(len(rows), i), rows, score))
            if not found:
                continue
            item, rows, score = (np.concatenate(x) for x in zip(*found, strict=True))
            # equal scores in the order of ids, null last
            place = np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(batch.column(0), null_placement="at_end").to_numpy()] = np.arange(batch.num_rows)
            by = np.lexsort((place[rows], -score, item))
            item, rows, score = item[by], rows[by], score[by]
            best = np.arange(len(item)) - np.searchsorted(item, item) < k
            yield pa.RecordBatch.from_arrays([pa.array(item[best]), batch.column(0).take(pa.array(rows[best])), pa.array(score[best])], ["item", "doc_id", "score"])

    return indexed.select("doc_id", "n", "terms", "tfs").mapInArrow(run, f"item long, doc_id {kind}, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """found with rank, the best k of every item. Spark keeps a task's best k before the shuffle."""
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _block(docs: DataFrame, terms_of: DataFrame, k: int) -> DataFrame:
    """item binary, rank, doc_id, score for the items of one block. terms_of: item, h."""
    spark = docs.sparkSession
    got = terms_of.toArrow()  # about BLOCK_TERMS rows of 24 bytes
    keys = got.column("item").combine_chunks().dictionary_encode()
    item, h = keys.indices.to_numpy(), got.column("h").to_numpy().view(U64)
    vocabulary = np.unique(h)
    sent = spark.sparkContext.broadcast(vocabulary)
    indexed = materialize(index(docs, sent), "search-index")
    sent.destroy()
    n_docs, n_terms = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    kind = dict(docs.dtypes)["doc_id"]
    none = f"item binary, doc_id {kind}, score long, rank int"
    if not n_terms or not len(h):
        release(indexed)
        return spark.createDataFrame([], none)
    df, most = term_bounds(indexed, len(vocabulary), n_docs, n_terms)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    term = np.searchsorted(vocabulary, h)
    orders, weights, rests, seeds = [], [], [], []
    by = np.lexsort((term, df[term], item))
    edge = np.searchsorted(item[by], np.arange(len(keys.dictionary) + 1))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        order = term[by[lo:hi]]
        order = order[df[order] > 0]
        bound = weight[order] * most[order]
        orders.append(order)
        weights.append(weight[order])
        rests.append(np.append(np.cumsum(bound[::-1])[::-1], 0))
        seeds.append(int(np.searchsorted(np.cumsum(df[order]), SEEDS)) + 1)

    def one(creating: list[int], floors: list[int]) -> DataFrame:
        plan = spark.sparkContext.broadcast((orders, weights, rests, creating, floors, n_docs, n_terms, len(vocabulary)))
        out = materialize(_best(_round(indexed, plan, k), k), "search-round")
        plan.destroy()
        return out

    first = one(seeds, [0] * len(orders))
    floors = [0] * len(orders)
    for i, score in first.where(F.col("rank") == k).select("item", "score").collect():  # a row an item of the block
        floors[i] = score
    second = one([-1] * len(orders), floors)
    names = spark.createDataFrame([(i, bytes(x)) for i, x in enumerate(keys.dictionary.to_pylist())], "item long, key binary")
    out = materialize(second.join(F.broadcast(names), "item").select(F.col("key").alias("item"), "doc_id", "score", "rank"), "search-result")  # names: the items of a block
    release(indexed, first, second)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of the highest scores above 0, equal ones by rising id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    content = [x for c in (item_col, item_text) for x in (F.col(c).isNull(), F.col(c))]
    key = F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), *content)), 16, "0") for s in (1, 2)]))
    named = materialize(items.select(key.alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).dropDuplicates(["item"]), "search-items")
    terms_of = materialize(item_terms(named), "item-terms")
    n_blocks = max(1, math.ceil(terms_of.count() / block_terms))
    parts = [_block(rows, terms_of.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i), k) for i in range(n_blocks)]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    out = materialize(out.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    release(named, terms_of, *parts)
    return out
