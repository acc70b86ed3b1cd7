"""Toxicity by a subsequence string kernel, Nystrom landmarks and a linear support vector machine.

The kernel counts common subsequences of three characters in a span of at most SPAN, each gap weighted by DECAY, so that
gapped and inserted-character spellings stay close to the word. Units are words with all but letters taken out, and runs
of single letters together; ends of a unit count as characters. Its feature space is small (32**3), so the machine trained
on landmark features folds into one weight for each subsequence, and scoring a text is one pass of array look-ups.

Training: from at most LABELLED labelled documents (a bounded sample by hash order, a documented limit on learning
only). Labels are of documents, so units get theirs by what documents hold them: a clean text's units are all negative, of
which the NEGATIVES that most documents hold, then others by hash, take part; a toxic text's witnesses are the units that
toxic texts hold far more often than clean ones, at most WITNESSES. LANDMARKS of both span the Nystrom features. These
limits bound what the driver gets and solves, whatever the input; README names them. A logistic curve over a text's best unit, its number of positive and of strong units and their rate gives
the score.

Defined results: null or empty text has no units and gets the score of a text without any; a document with several labels
counts as toxic if one says so; without both classes in training every score is the toxic share (0 if there are no labels);
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import BYTES, LOWER, SPACED, blocks

SPAN, DECAY, EDGE = 6, 0.6, 31
LABELLED, LANDMARKS, NEGATIVES, WITNESSES = 20_000, 128, 6_000, 256
PARTS = 8
#: standard deviations from chance for a witness; the margin of a strong unit; a rate's scale
APART, STRONG, RATE = 3.0, 0.5, 50.0
STEPS = [(i, j, DECAY ** (i + j - 2)) for i in range(1, SPAN) for j in range(1, SPAN) if i + j < SPAN]
LETTERS = np.full(256, -1, np.int32)
LETTERS[97:123] = np.arange(26)
LETTERS[128:] = 26 + BYTES[128:].astype(np.int32) % 5


def _units(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all units with an EDGE at both ends, the unit of each, and the row of each unit."""
    start, end, row = b.words(SPACED)
    c = LETTERS[LOWER[b.data]]
    kept = np.concatenate([[0], np.cumsum(c >= 0)])
    size = kept[end] - kept[start]
    some = size > 0
    size, row = size[some], row[some]
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    joined = np.zeros(len(size), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (row[1:] == row[:-1])
    unit_of_word = np.cumsum(~joined) - 1
    size = np.bincount(unit_of_word, weights=size).astype(np.int64)
    row = row[~joined]
    letters = c[(c >= 0) & SPACED[b.data]]
    unit = np.repeat(np.arange(len(size)), size)
    out = np.full(len(letters) + 2 * len(size), EDGE, np.int32)
    out[np.arange(len(letters)) + 2 * unit + 1] = letters
    return out, np.repeat(np.arange(len(size)), size + 2), row


def _codes(c: np.ndarray, unit: np.ndarray):
    """For each step: first places of subsequences within a unit, their codes and weight."""
    for i, j, w in STEPS:
        n = len(c) - i - j
        if n > 0:
            at = np.flatnonzero(unit[:n] == unit[i + j :])
            yield at, (c[at] << 10) | (c[at + i] << 5) | c[at + i + j], w


def _norms(size: np.ndarray) -> np.ndarray:
    """Length of a unit's feature vector, by its number of characters with the ends (as if none repeats)."""
    total = np.zeros(len(size))
    for i, j, w in STEPS:
        total += np.maximum(size - i - j, 0) * w * w
    return np.sqrt(np.maximum(total, 1e-9))


def unit_scores(c: np.ndarray, unit: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Normalised inner product of every unit with a weight for each subsequence."""
    s = np.zeros(len(c), np.float32)
    for at, code, w in _codes(c, unit):
        s[at] += w * weights[code]
    return np.bincount(unit, weights=s, minlength=n) / _norms(np.bincount(unit, minlength=n))


def _of_words(words: list[str]):
    b = next(blocks(pa.array(words, pa.large_string()), 1 << 40))
    c, unit, row = _units(b)
    return c, unit, row


def kernel(words: list[str], features: np.ndarray) -> np.ndarray:
    """Normalised kernel of words (one unit each) with rows of landmark features."""
    c, unit, row = _of_words(words)
    out = np.zeros((len(words), len(features)))
    for j, f in enumerate(features):
        out[row, j] = unit_scores(c, unit, len(row), f)
    return out


def landmark_features(words: list[str]) -> np.ndarray:
    c, unit, row = _of_words(words)
    out = np.zeros((len(words), 1 << 15), np.float32)
    size = _norms(np.bincount(unit, minlength=len(row)))
    for at, code, w in _codes(c, unit):
        np.add.at(out, (row[unit[at]], code), w)
    out[row] /= size[:, None]
    return out


def train_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and intercept of a linear machine with squared hinge loss, by Newton steps over its active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


@dataclass
class ToxicModel:
    weights: np.ndarray
    offset: float
    curve: tuple[float, ...]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, lightly drawn to zero."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _word_table(sample: DataFrame) -> DataFrame:
    """word, t, c: toxic and clean documents of the sample that hold it."""

    def run(batches):
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = sorted({w for w in ("".join(ch for ch in x if ch.isalpha()) for x in (text or "").lower().split()) if len(w) > 2})
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([toxic] * len(words), pa.int64())], ["word", "toxic"])

    seen = sample.select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(run, "word string, toxic long")
    # few partitions: the sample is bounded, and each of them sends its own first words to the driver
    return seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).coalesce(PARTS)


def measures(docs: DataFrame, weights, offset: float, text_col: str = "text") -> DataFrame:
    """docs without the text, with best (the best unit's margin), hits (units with a positive margin), strong (with a
    margin over STRONG) and units."""
    keep = [c for c in docs.columns if c != text_col]

    def run(batches):
        table = weights.value
        for batch in batches:
            best, (hits, strong, units) = np.full(batch.num_rows, -2.0), np.zeros((3, batch.num_rows), np.int64)
            for b in blocks(batch.column(len(keep))):
                c, unit, row = _units(b)
                if len(row):
                    s = unit_scores(c, unit, len(row), table) + offset
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    best[b.first + row[first]] = np.maximum(np.maximum.reduceat(s, first), -2.0)
                    for out, on in ((hits, s > 0), (strong, s > STRONG), (units, s > -np.inf)):
                        out[b.first : b.first + b.rows] = np.bincount(row, weights=on, minlength=b.rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *map(pa.array, (best, hits, strong, units))], [*keep, "best", "hits", "strong", "units"])

    kinds = "".join(f"`{c}` {k}, " for c, k in docs.dtypes if c != text_col)
    return docs.select(*keep, text_col).mapInArrow(run, f"{kinds}best double, hits long, strong long, units long")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[ToxicModel | None, float]:
    """docs: doc_id, text; labels: doc_id, toxic, those to learn from. The model and the toxic share."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    sample = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")  # labelled rows at most
    sample = sample.persist()
    try:
        n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
        toxic, clean = n.get(1, 0), n.get(0, 0)
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        if not toxic or not clean:
            return None, share
        table = _word_table(sample).persist()
        by_chance = (F.col("t") + F.col("c")) * share
        apart = (F.col("t") - by_chance) / F.sqrt(by_chance + 0.5)
        witness = [r["word"] for r in table.where((apart > APART) & (F.col("t") > F.col("c"))).orderBy(apart.desc(), "word").limit(WITNESSES).collect()]
        negative = [r["word"] for r in table.where("t = 0 or c > t").orderBy((F.col("c") < 20), F.xxhash64("word"), "word").limit(NEGATIVES).collect()]
        table.unpersist()
        if not witness or not negative:
            return None, share
        marks = (witness + negative)[: LANDMARKS // 2] + negative[:: max(1, len(negative) // (LANDMARKS // 2))]
        marks = list(dict.fromkeys(marks))[:LANDMARKS]
        features = landmark_features(marks)
        value, vector = np.linalg.eigh(features.astype(float) @ features.T)
        good = value > 1e-6
        root = vector[:, good] / np.sqrt(value[good])
        x = kernel(witness + negative, features) @ root
        y = np.array([1.0] * len(witness) + [-1.0] * len(negative))
        cost = np.where(y > 0, 10.0 * max(1.0, len(negative) / len(witness) / 10), 10.0)
        w = train_svm(x, y, cost)
        weights = ((root @ w[:-1]) @ features).astype(np.float32)
        offset = float(w[-1])
        got = measures(sample, spark.sparkContext.broadcast(weights), offset).toPandas()  # labelled rows at most
        curve = _fit_curve(np.stack([got["best"], np.log1p(got["hits"]), np.log1p(got["strong"]), np.minimum(RATE * got["hits"] / np.maximum(got["units"], 1), 5)], 1), got["toxic"].to_numpy(float))
        return ToxicModel(weights, offset, tuple(map(float, curve))), share
    finally:
        sample.unpersist()


def held_out(id_col: str = "doc_id", of: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % of == rest, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; labels of held-out rows are not read."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model, share = train(rows, labels.select(F.col(id_col).alias("doc_id"), "toxic").where(~held_out("doc_id")))
    if model is None:
        scored = rows.select("doc_id", F.lit(share).alias("score"))
    else:
        a, b, c, d, e = model.curve
        got = measures(rows, spark.sparkContext.broadcast(model.weights), model.offset)
        rate = F.least(RATE * F.col("hits") / F.greatest("units", F.lit(1)), F.lit(5.0))
        scored = got.withColumn("score", 1 / (1 + F.exp(-(F.col("best") * a + F.log1p(F.col("hits").cast("double")) * b + F.log1p(F.col("strong").cast("double")) * c + rate * d + e))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
