"""Benchmark passages in training texts, by winnowing.

A window is WINDOW consecutive words of an item, or a whole shorter item. Both sides keep the least hash of
every SPAN consecutive GRAM-word hashes (SPAN + GRAM - 1 = WINDOW words), so every shared run of WINDOW words
has a shared fingerprint. A fingerprint carries the hashes of the words around it; a join on the fingerprint
pairs places, and comparing the words around them extends each hit: since every window of a shared run has
its own fingerprint, WINDOW - GRAM words to either side are enough. Items of fewer words are looked up whole,
as GRAM = their length.

Before the shuffle, documents' fingerprints are held against a bitmap of 2**BITS bits, made from the items:
its size is fixed, and it only spares rows that would find no partner.

Rows are known by a 128-bit digest of their text, so equal texts share their work.

Defined results: null text has no words; items without words match nothing; a null item id is the string
"null" in lists; other columns are ignored; rows that share a doc_id are scored each on its own text, as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import ALNUM, LOWER, U64, blocks, mix, ngrams
from lumenlake.shared import materialize, release

WINDOW, GRAM, BITS = 10, 5, 22
SPAN, SIDE = WINDOW - GRAM + 1, WINDOW - GRAM
AROUND = GRAM + 2 * SIDE
#: more fingerprints than this are joined by shuffle, not by broadcast
BROADCAST_ROWS = 200_000


def _fingerprints(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word place of the least GRAM-word hash of every window, the last of equal ones."""
    grams, _ = ngrams(h, row, GRAM)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, SPAN):
        lower = grams[j : j + n] <= least
        least[lower], where[lower] = grams[j : j + n][lower], j
    at = np.unique((np.arange(n) + where)[row[:n] == row[WINDOW - 1 :]])
    return grams[at], at


def _around(h: np.ndarray, row: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """The AROUND word hashes about each place; outside stands for words beyond the text."""
    place = at[:, None] + np.arange(-SIDE, GRAM + SIDE)
    inside = (place >= 0) & (place < len(h))
    place = np.clip(place, 0, max(len(h) - 1, 0))
    inside &= row[place] == row[at][:, None]
    return np.where(inside, h[place], U64(outside)).astype(U64)


def _whole(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every n consecutive words, told apart from other lengths."""
    grams, at = ngrams(h, row, n)
    return grams[at] ^ mix(np.array([n], U64))[0], at


FINGERPRINTS = "row binary, at long, words int, fp long, around binary"


def _scan(docs: DataFrame, bitmap=None, lengths=range(1, WINDOW), outside: int = 1) -> DataFrame:
    """Fingerprints of column text, keyed by column row (binary); without a bitmap, those of items: short ones whole."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, row = b.word_hashes(ALNUM, LOWER)
                size = np.bincount(row, minlength=b.rows) if len(row) else np.zeros(b.rows, np.int64)
                first = np.concatenate([[0], np.cumsum(size)])
                parts = []
                for n in (0, *lengths):
                    fp, at = _whole(h, row, n) if n else _fingerprints(h, row)
                    if n and bitmap is None:
                        fp, at = fp[size[row[at]] == n], at[size[row[at]] == n]
                    if bitmap is not None:
                        bits = np.frombuffer(bitmap.value, np.uint8)
                        slot = (fp >> U64(64 - BITS)).astype(np.int64)
                        hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                        fp, at = fp[hit], at[hit]
                    parts.append((fp, at, np.full(len(at), n, np.int32)))
                fp, at, words = (np.concatenate([p[i] for p in parts]) for i in range(3))
                if len(at):
                    raw = _around(h, row, at, outside)
                    near = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * AROUND * 8).astype(np.int32)), pa.py_buffer(raw.tobytes())])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b.first + row[at])), pa.array(at - first[row[at]]), pa.array(words), pa.array(fp.view(np.int64)), near], ["row", "at", "words", "fp", "around"])

    return docs.mapInArrow(run, FINGERPRINTS)


def _extend(joined: DataFrame) -> DataFrame:
    """From fingerprints that meet: row, item, and the words of the row that lie in shared windows, [lo, hi)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            row, at, words, a, item, b = (batch.column(i) for i in range(6))
            same = np.frombuffer(b"".join(a.to_pylist()), U64).reshape(n, AROUND) == np.frombuffer(b"".join(b.to_pylist()), U64).reshape(n, AROUND)
            words, at = words.to_numpy(), at.to_numpy()
            left = np.logical_and.accumulate(same[:, SIDE - 1 :: -1], axis=1).sum(1)
            right = np.logical_and.accumulate(same[:, SIDE + GRAM :], axis=1).sum(1)
            long = words == 0
            ok = np.where(long, same[:, SIDE : SIDE + GRAM].all(1) & (left + GRAM + right >= WINDOW), True)
            lo, hi = np.where(long, at - left, at), np.where(long, at + GRAM + right, at + words)
            yield pa.RecordBatch.from_arrays([row, item, pa.array(lo), pa.array(hi)], ["row", "item", "lo", "hi"]).filter(pa.array(ok))

    return joined.select("row", "at", "words", "around", "item", "item_around").mapInArrow(run, "row binary, item string, lo long, hi long")


def _digest(*columns: str) -> Column:
    """128 bits; null is not empty."""
    return F.unhex(F.md5(F.concat_ws(":", *[F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n")) for c in columns])))


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs: row binary, text; items: item string, text. Rows (row, item, lo, hi): words lo to hi of the row's text
    lie in windows of the item. Overlapping stretches are not merged."""
    spark = docs.sparkSession
    numbered = materialize(items.select(_digest("item", "text").alias("row"), F.col("item").cast("string").alias("item"), "text").distinct(), "items")
    prints = materialize(_scan(numbered.select("row", "text"), outside=2), "item-prints")
    width = 1 << (BITS - 3)
    slots = prints.select(F.shiftrightunsigned("fp", 64 - BITS).alias("s")).select((F.col("s") / 8).cast("int").alias("byte"), F.pmod("s", F.lit(8)).cast("int").alias("bit"))
    marks = slots.distinct().groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("v")).toPandas()  # at most 2**(BITS-3) rows
    bits = np.zeros(width, np.uint8)
    bits[marks["byte"].to_numpy(np.int64)] = marks["v"].to_numpy(np.uint8)
    lengths = [r[0] for r in prints.where("words > 0").select("words").distinct().collect()]  # below WINDOW
    bitmap = spark.sparkContext.broadcast(bits.tobytes())
    found = _scan(docs.select("row", "text"), bitmap, sorted(lengths), outside=1)
    known = prints.join(numbered.select("row", "item"), "row").select("fp", F.col("words").alias("w"), "item", F.col("around").alias("item_around")).distinct()
    known = materialize(known, "known")
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    return _extend(found.join(known, (found.fp == known.fp) & (found.words == known.w)).drop("fp"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), items_sha256, contaminated; a row for each document. keep: columns to carry along."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text")).withColumn("row", _digest("text"))
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    hits = matches(rows.select("row", "text"), bench)
    # stretches of one row: at most as many as its words; merged in order by a running maximum
    per = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["hi"] - F.greatest(a["to"], s["lo"]))).alias("n"), F.greatest(a["to"], s["hi"]).alias("to")),
        lambda a: a["n"],
    )
    per = per.select("row", covered.alias("n_hit"), "items")

    def sizes(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for b in blocks(batch.column(len(known))):
                _, _, row = b.words(ALNUM)
                out[b.first : b.first + b.rows] = np.bincount(row, minlength=b.rows) if len(row) else 0
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(known))], pa.array(out)], [*known, "n_words"])

    known = ["doc_id", *keep, "row"]
    kinds = ", ".join(f"`{c}` {k}" for c, k in rows.select(*known).dtypes)
    counted = rows.select(*known, "text").mapInArrow(sizes, f"{kinds}, n_words long")
    out = counted.join(per, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id",
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
