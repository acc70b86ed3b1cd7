"""Log probabilities of texts: the marginal likelihood of a subword lattice, and smoothed word counts as a base.

A text's probability is that of its words and an end; a word's is the sum over all of its segmentations into pieces of an
existing vocabulary, by log-space forward recursion. Words part at white space, where a piece may not cross, so that the
text's lattice is the chain of its words' lattices and the recursion runs once for each distinct word. Pieces weigh by the
vocabulary's scores; those of a merge-ranked vocabulary are read as Zipf weights, 1 / (rank + ZIPF). Passes of expectation
and maximisation over all training words, each as often as it occurs, then fit the weights, and how often a word ends after
a piece; the pieces stay. Single bytes are pieces too, so that every text has a probability.

Spark counts the words of all documents. Frequent words, at most HOT of them by construction (each has more than 1 / HOT of
all tokens), are broadcast with their values; places of all others meet theirs in a join, so no key holds more than 1 / HOT
of the tokens. Which way a word goes changes no value.

Defined results: null text is empty and has its end token only; a null doc_id is not held out; rows are scored one by one,
repeated ones alike; without training documents N and V are 0 and the weights are the vocabulary's own; a word of very many
bytes is scored whole, in as many steps and by stretches of STRETCH bytes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import LOWER, SAME, SPACED, U64, Block, blocks
from lumenlake.shared import materialize, release

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ZIPF, STOP, HOT, SHARE_OF_BYTES = 50.0, 0.35, 200_000, 0.01
#: uses that the given weights count for in a pass
PRIOR = 100.0
MARK = "▁".encode()
#: bytes of words in one lattice; a longer word is taken in stretches of as many
STRETCH = 100_000
#: bytes of distinct words that a task holds before it hands them on
HELD_BYTES = 32 << 20


def vocabulary(path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Pieces as bytes (word starts marked by MARK) and their natural log weights, which sum to one with the single bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            pieces[sp.id_to_piece(i).encode()] = sp.get_score(i)
    scores = np.array(list(pieces.values()))
    ranked = np.unique(scores).size > 1 and np.array_equal(scores, np.round(scores))
    weight = 1 / (scores.max() - scores + ZIPF) if ranked else np.exp(scores)
    weight *= (1 - SHARE_OF_BYTES) / weight.sum()
    for byte in range(256):
        pieces.setdefault(bytes([byte]), 0.0)
    names = list(pieces)
    total = np.full(len(names), 0.0)
    total[: len(weight)] = weight
    total[[names.index(bytes([b])) for b in range(256)]] += SHARE_OF_BYTES / 256
    return np.array(names, object), np.log(total)


def _span_table(names: np.ndarray, logs: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> sorted hashes and log weights of the pieces of that length."""
    out = {}
    size = np.array([len(x) for x in names])
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        b = next(blocks(pa.array([bytes(x) for x in names[own]], pa.large_binary()), 1 << 40))
        h = Block.span(b.prefix(SAME), b.offs[:-1], b.offs[1:])
        order = np.argsort(h)
        out[int(n)] = (h[order], logs[own][order])
    return out


def lattice(words: list[bytes], table: dict[int, tuple[np.ndarray, np.ndarray]], weights: np.ndarray | None = None, stop: float = STOP):
    """Natural log of the marginal probability of each word over all segmentations, by log-space forward recursion; after a
    piece the word ends with probability stop.

    With weights (one a word): each piece's expected uses instead, length -> array, by a backward recursion as well."""
    b = next(blocks(pa.array([MARK + w for w in words], pa.large_binary()), 1 << 40))
    prefix, n = b.prefix(SAME), len(b.data)
    first, size = b.offs[:-1], np.diff(b.offs)
    word = np.repeat(np.arange(len(words)), size)
    left = b.offs[1:][word] - np.arange(n)
    arcs, which = {}, {}
    for k, (known, logs) in table.items():
        at = np.flatnonzero(left >= k)
        if len(at):
            h = Block.span(prefix, at, at + k)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            if hit.any():
                arcs[k] = np.full(n, -np.inf)
                arcs[k][at[hit]] = logs[i[hit]]
                which[k] = at[hit], i[hit]
    go = np.log(1 - stop)
    base = first + np.arange(len(words))  # a word's places 0..size are at its base + place
    order = np.argsort(-size, kind="stable")
    by_size = size[order]

    def run(forward: bool) -> np.ndarray:
        out = np.full(n + len(words), -np.inf)
        out[base if forward else base + size] = 0.0
        alive = len(words)
        with np.errstate(divide="ignore", invalid="ignore"):
            for t in range(1, int(size.max(initial=0)) + 1):
                while alive and by_size[alive - 1] < t:
                    alive -= 1
                own = order[:alive]
                here = base[own] + (t if forward else size[own] - t)
                start = first[own] + (t if forward else size[own] - t)
                rows = [out[here - k] + arc[start - k] if forward else out[here + k] + arc[start] for k, arc in arcs.items() if k <= t]
                m = np.stack(rows)
                top = m.max(0)
                safe = np.where(np.isfinite(top), top, 0)
                out[here] = safe + np.log(np.exp(m - safe).sum(0)) + go
        return out

    alpha = run(True)
    if weights is None:
        return alpha[base + size] - go + np.log(stop)
    beta = run(False)
    whole = alpha[base + size]
    out = {}
    for k, (at, i) in which.items():
        w = word[at]
        place = at + w
        uses = np.exp(alpha[place] + arcs[k][at] + go + beta[place + k] - whole[w]) * weights[w]
        out[k] = np.bincount(i, weights=uses, minlength=len(table[k][0]))
    return out


def _long_word(word: bytes, table: dict[int, tuple[np.ndarray, np.ndarray]], weight: float | None = None, stop: float = STOP, stretch: int = STRETCH):
    """What lattice gives for one word, by stretches of its bytes: only a stretch's arcs are held, and the forward values at the
    stretches' ends, from which the backward pass makes those inside anew."""
    data, go = MARK + word, np.log(1 - stop)
    n, sizes = len(data), np.array(sorted(table))
    reach = int(sizes.max())

    def arcs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Log weights and places in the table of the pieces from each byte a..b on, a column a size."""
        own = next(blocks(pa.array([data[a : b + reach]], pa.large_binary()), 1 << 40))
        prefix, at = own.prefix(SAME), np.arange(b - a)
        logs, which = np.full((b - a, len(sizes)), -np.inf), np.zeros((b - a, len(sizes)), np.int64)
        for c, k in enumerate(sizes):
            some = at[at + k <= len(own.data)]
            known, values = table[int(k)]
            h = Block.span(prefix, some, some + k)
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[i] == h
            logs[some[hit], c], which[some[hit], c] = values[i[hit]], i[hit]
        return logs, which

    def forward(logs: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.full(len(logs) + reach + 1, -np.inf)
        out[: reach + 1] = first
        for t in range(len(logs)):
            out[t + sizes] = np.logaddexp(out[t + sizes], out[t] + logs[t] + go)
        return out

    starts, ends = list(range(0, n, stretch)), np.full(reach + 1, -np.inf)
    ends[0], saved = 0.0, []
    for a in starts:
        b = min(a + stretch, n)
        saved.append(ends)
        ends = forward(arcs(a, b)[0], ends)[b - a :]
    whole = ends[0]
    if weight is None:
        return whole - go + np.log(stop)
    uses = {k: np.zeros(len(v[0])) for k, v in table.items()}
    after = np.full(reach + 1, -np.inf)
    after[0] = 0.0
    for a, first in zip(reversed(starts), reversed(saved), strict=True):
        b = min(a + stretch, n)
        logs, which = arcs(a, b)
        alpha = forward(logs, first)
        beta = np.concatenate([np.full(b - a, -np.inf), after])
        for t in range(b - a - 1, -1, -1):
            m = logs[t] + go + beta[t + sizes]
            top = m.max()
            beta[t] = top + np.log(np.exp(m - top).sum()) if np.isfinite(top) else top
        at = np.arange(b - a)[:, None]
        got = np.exp(alpha[at] + logs + go + beta[at + sizes[None]] - whole) * weight
        for c, k in enumerate(sizes):
            uses[int(k)] += np.bincount(which[:, c], weights=got[:, c], minlength=len(uses[int(k)]))
        after = beta[: reach + 1]
    return uses


def _by_bytes(words: list[bytes], most: int = STRETCH) -> Iterator[slice]:
    """Slices of words of most bytes together, or of one longer word."""
    at, held = 0, 0
    for i, w in enumerate(words):
        if i > at and held + len(w) > most:
            yield slice(at, i)
            at, held = i, 0
        held += len(w)
    if at < len(words):
        yield slice(at, len(words))


def values_of(words: list[bytes], table: dict[int, tuple[np.ndarray, np.ndarray]], stop: float = STOP, most: int = STRETCH) -> np.ndarray:
    """Natural log probability of each word; memory follows most bytes, not the words."""
    parts = [np.array([_long_word(words[s.start], table, None, stop, most)]) if len(words[s.start]) > most else lattice(words[s], table, None, stop) for s in _by_bytes(words, most)]
    return np.concatenate(parts) if parts else np.zeros(0)


def uses_of(words: list[bytes], n: np.ndarray, table: dict[int, tuple[np.ndarray, np.ndarray]], stop: float = STOP, most: int = STRETCH) -> dict[int, np.ndarray]:
    """Expected uses of every piece in the words, the ith n[i] times."""
    held = {k: np.zeros(len(v[0])) for k, v in table.items()}
    for s in _by_bytes(words, most):
        got = _long_word(words[s.start], table, float(n[s.start]), stop, most) if len(words[s.start]) > most else lattice(words[s], table, n[s], stop)
        for k, x in got.items():
            held[k] += x
    return held


def reweighted(words: DataFrame, table: dict[int, tuple[np.ndarray, np.ndarray]], stop: float = STOP) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], float]:
    """The vocabulary's weights and the chance of an end after one pass of expectation and maximisation over the training
    words, each as often as it occurs, drawn towards the given weights by PRIOR uses in all. Tasks send a number a piece."""
    sent = words.sparkSession.sparkContext.broadcast((table, stop))

    def run(batches):
        own, end = sent.value
        held = {k: np.zeros(len(v[0])) for k, v in own.items()}
        for batch in batches:
            texts, n = [w.encode() for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(float)
            for k, got in uses_of(texts, n, own, end).items():
                held[k] += got
        for k, x in held.items():
            at = np.flatnonzero(x)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(x[at])], ["size", "i", "x"])

    train = words.where("n_train > 0")
    got = train.select("word", "n_train").mapInArrow(run, "size long, i long, x double").groupBy("size", "i").agg(F.sum("x").alias("x")).toPandas()  # a row a piece
    n = float(train.agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0])
    sent.destroy()
    if not n:
        return table, stop
    uses = {k: np.exp(v[1]) * PRIOR for k, v in table.items()}
    for k, own in got.groupby("size"):
        uses[int(k)][own["i"].to_numpy()] += own["x"].to_numpy()
    total = sum(x.sum() for x in uses.values())
    return {k: (v[0], np.log(uses[k] / total)) for k, v in table.items()}, (n + PRIOR * stop) / (float(got["x"].sum()) + PRIOR)


def word_table(docs: DataFrame) -> DataFrame:
    """docs: train boolean, text. h, word, n_train, n over all documents' words."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def merged():
            h, words, t, n = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at, where = np.unique(h, return_index=True, return_inverse=True)
            return key, words[at], np.bincount(where, weights=t), np.bincount(where, weights=n)

        def rows():
            h, words, t, n = merged()
            held.clear()
            for s in _by_bytes(words, 4 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(words[s].tolist(), pa.binary()).cast(pa.string()), pa.array(t[s].astype(np.int64)), pa.array(n[s].astype(np.int64))], ["h", "word", "n_train", "n"])

        for batch in batches:
            train = batch.column(0).to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                start, end, row = b.words(SPACED)
                if not len(start):
                    continue
                h = b.span(b.prefix(LOWER), start, end)
                key, at, where, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                t = np.bincount(where, weights=train[b.first + row])
                low = LOWER[b.data].tobytes()
                words = np.empty(len(key), object)
                words[:] = [low[i:j] for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                held.append((key, words, t, n))
                size += int((end[at] - start[at]).sum())
                if len(held) > 1 and (size > HELD_BYTES or sum(len(x[0]) for x in held) > 400_000):
                    held[:] = [merged()]
                    size = sum(map(len, held[0][1]))
                    if size > HELD_BYTES // 2 or len(held[0][0]) > 300_000:
                        yield from rows()
                        size = 0
        if held:
            yield from rows()

    return docs.select("train", "text").mapInArrow(run, "h long, word string, n_train long, n long").groupBy("h", "word").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n"))


def _valued(words: DataFrame, model) -> DataFrame:
    """h, n, n_train and each word's log10 probability by the lattice."""

    def run(batches):
        table, stop = model.value
        for batch in batches:
            logp = values_of([w.encode() for w in batch.column(1).to_pylist()], table, stop) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(logp)], ["h", "n_train", "n", "logp"])

    return words.select("h", "word", "n_train", "n").mapInArrow(run, "h long, n_train long, n long, logp double")


def score_texts(docs: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, passes: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False)))
    rows = rows.withColumn("row", F.unhex(F.md5(F.coalesce(F.concat(F.lit("v"), "text"), F.lit("n")))))
    counts = materialize(word_table(rows.select((~F.col("held_out")).alias("train"), "text")), "word-counts")
    ends = rows.where("not held_out").count()
    total, words, all_words = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = total + ends, words + (ends > 0)
    table, stop = _span_table(*vocabulary(vocabulary_path)), STOP
    for _ in range(passes):
        table, stop = reweighted(counts, table, stop)
    pieces = spark.sparkContext.broadcast((table, stop))
    valued = materialize(_valued(counts, pieces), "word-values")
    pieces.destroy()
    hot = valued.where(F.col("n") > all_words / HOT).select("h", "n_train", "logp").toPandas().sort_values("h")  # fewer than HOT rows
    known = spark.sparkContext.broadcast((hot["h"].to_numpy(np.int64), np.log10(hot["n_train"].to_numpy(float) + 1), hot["n_train"].to_numpy() > 0, hot["logp"].to_numpy(float)))

    def run(batches):
        keys, base, seen, logp = known.value
        for batch in batches:
            for b in blocks(batch.column(1)):
                h, row = b.word_hashes(SPACED, LOWER)
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                at, own = at[hit], row[hit]
                sums = [np.bincount(row, minlength=b.rows) if len(row) else np.zeros(b.rows, np.int64)]
                sums += [np.bincount(own, weights=x[at], minlength=b.rows) if len(own) else np.zeros(b.rows) for x in (seen, base, logp)]
                # the other words of a row, once each with their number
                cold, crow = h[~hit], row[~hit]
                order = np.lexsort((cold, crow))
                cold, crow = cold[order], crow[order]
                new = np.ones(len(cold), bool)
                new[1:] = (cold[1:] != cold[:-1]) | (crow[1:] != crow[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(cold))).astype(np.int32)
                edge = np.searchsorted(crow[first], np.arange(b.rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays([pa.array(cold[first]), pa.array(times)], ["h", "k"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.rows), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2]), pa.array(sums[3]), lists], ["row", "words", "seen", "base", "logp", "cold"])

    scored = rows.select("row", "text").mapInArrow(run, "row binary, words long, seen long, base double, logp double, cold array<struct<h:long,k:int>>")
    scored = materialize(scored, "hot-scores")
    known.destroy()
    rest = valued.select(F.col("h").alias("h2"), (F.col("n_train") > 0).alias("in_train"), F.log10(F.col("n_train") + 1).alias("b"), F.col("logp").alias("m"))
    places = scored.select("row", F.explode("cold").alias("x")).select("row", "x.h", "x.k").join(rest, F.col("h") == F.col("h2"))
    sums = places.groupBy("row").agg(F.sum(F.when(F.col("in_train"), F.col("k")).otherwise(0)).alias("seen2"), F.sum(F.col("k") * F.col("b")).alias("base2"), F.sum(F.col("k") * F.col("m")).alias("logp2"))
    copies = scored.groupBy("row").agg(F.count("*").alias("copies"), F.max("words").alias("words"), F.max("seen").alias("seen"), F.max("base").alias("base"), F.max("logp").alias("logp"))
    per = copies.join(sums, "row", "left")
    own = rows.select("doc_id", "held_out", "row").join(per, "row")
    part = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    end_base = float(np.log10(ends + 1))
    end_p = (ends + 0.5) / (n + 1)  # the end of the text rather than a word
    tokens = F.col("words") + 1
    out = own.select(
        "doc_id",
        "held_out",
        tokens.alias("n_tokens"),
        (F.col("seen") + part("seen2") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + part("base2") + end_base - tokens * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("logp") + part("logp2") + F.col("words") * float(np.log10(1 - end_p)) + float(np.log10(end_p))).alias("score"),
    )
    out = materialize(out, "scores")
    release(counts, valued, scored)
    return out
