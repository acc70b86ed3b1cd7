"""Removal of every byte that a LENGTH-byte string, found elsewhere too, covers: by surroundings of rolling-hash triggers.

Triggers cut all texts alike, as in prefix-free parsing, of which this keeps no more (no suffix arrays; README has the
figures): places whose rolling hash of TRIGGER bytes is the least of some LENGTH-byte window. Every window has one, so any
repeated string meets its copies at a trigger. For each trigger string its distinct surroundings are gathered (LENGTH bytes to
the right, LENGTH - TRIGGER to the left, inside the document), with their places. Surroundings that occur twice are repeated
throughout. The others of a trigger are compared by the 64-bit hashes of all their LENGTH-byte windows, so each window's answer
is exact but for collisions of hashes. A trigger with more than GROUP different surroundings is narrowed down by shuffles
instead, in work that grows with their number, so that no task holds a whole group.

Rows are known by 96 bits of their content.

Text is read twice and shuffled by row at most once a join; what else moves is a few bytes a trigger.

Defined results: null text is empty; shorter texts have no windows; matches never cross rows; repeated rows are repeats
of one another; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.textblocks import SAME, U64, Block, blocks, mix
from lumenlake.shared import materialize, release

LENGTH, TRIGGER, GROUP = 400, 32, 800
#: surroundings, of whole triggers, that a task compares at once
AT_ONCE = 4000
#: distances of windows whose keys are made at once
DISTANCES = 64
RANGES = 8


def _sliding_least(x: np.ndarray, w: np.ndarray | int) -> np.ndarray:
    """Least of every w consecutive values, by block-wise running minima."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(np.uint64).max, U64)
    blocked = np.concatenate([x, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocked, axis=1).ravel()
    behind = np.minimum.accumulate(blocked[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def triggers(h: np.ndarray, length: int, trigger: int) -> np.ndarray:
    """Places of one text's trigger hashes that are the least of some window of length bytes."""
    w = length - trigger + 1
    least = _sliding_least(h, w)
    # a place is a trigger if the largest window minimum over the windows that hold it is its own hash
    edge = np.zeros(w - 1, U64)
    most = ~_sliding_least(~np.concatenate([edge, least, edge]), w)
    return np.flatnonzero(most == h)


def occurrences(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """rows: row binary, text. row, at, hi, gram (the trigger's hash), around (that of the surroundings, up to hi)."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1)):
                if len(b.data) < length:
                    continue
                prefix = b.prefix(SAME)
                every = np.arange(len(b.data) - trigger + 1)
                h = b.span(prefix, every, every + trigger)
                at, row = [], []
                for i in np.flatnonzero(np.diff(b.offs) >= length):
                    got = triggers(h[b.offs[i] : b.offs[i + 1] - trigger + 1], length, trigger)
                    at.append(got + b.offs[i])
                    row.append(np.full(len(got), i))
                if not at:
                    continue
                at, row = np.concatenate(at), np.concatenate(row)
                lo, hi = np.maximum(at - (length - trigger), b.offs[row]), np.minimum(at + length, b.offs[row + 1])
                around = mix(b.span(prefix, lo, hi) ^ ((at - lo).astype(U64) << U64(20) | (hi - at).astype(U64)))
                first = b.offs[row]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(b.first + row)), *[pa.array((x - first).astype(np.int32)) for x in (at, hi)], pa.array(h[at].view(np.int64)), pa.array(around.view(np.int64))], ["row", "at", "hi", "gram", "around"])

    return rows.select("row", "text").mapInArrow(run, "row binary, at int, hi int, gram long, around long")


def _fetch(rows: DataFrame, some: DataFrame, length: int, trigger: int) -> DataFrame:
    """some: row, at, hi, gram, lone, many. row, at, lo, gram, lone, many, bytes: the surroundings of every place."""

    def run(batches):
        for batch in batches:
            for i, wanted in enumerate(batch.column(2).to_pylist()):
                data = batch.column(1)[i].as_buffer()
                for at in range(0, len(wanted), 5000):
                    part = wanted[at : at + 5000]
                    low = [max(w["at"] - (length - trigger), 0) for w in part]
                    cut = [data.slice(a, w["hi"] - a).to_pybytes() for a, w in zip(low, part, strict=True)]
                    of = lambda k, t: pa.array([w[k] for w in part], t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(part))), of("at", pa.int32()), pa.array(low, pa.int32()), of("gram", pa.int64()), of("lone", pa.bool_()), of("many", pa.bool_()), pa.array(cut, pa.binary())], ["row", "at", "lo", "gram", "lone", "many", "bytes"])

    wanted = some.groupBy("row").agg(F.collect_list(F.struct("at", "hi", "gram", "lone", "many")).alias("wanted"))  # a row's own triggers
    texts = rows.select("row", "text").dropDuplicates(["row"])
    return texts.join(wanted, "row").select("row", "text", "wanted").mapInArrow(run, "row binary, at int, lo int, gram long, lone boolean, many boolean, bytes binary")


def _window_keys(group: np.ndarray, place: np.ndarray, column: pa.Array, length: int, trigger: int):
    """For each distance d of a window's start before the trigger: d, the surroundings that hold such a window, and its keys,
    which are equal for equal windows of a group at one distance. Sums are read along each surroundings' bytes."""
    b = next(blocks(column, 1 << 40))
    prefix = b.prefix(SAME)
    trig = b.offs[:-1] + place
    salt = mix(group.astype(np.int64).view(U64))[:, None]
    scale = b.inverse(prefix, trig)[:, None]
    for low in range(0, length - trigger + 1, DISTANCES):
        d = np.arange(low, min(low + DISTANCES, length - trigger + 1))
        start = trig[:, None] - d
        fits = ((place[:, None] >= d) & (start + length <= b.offs[1:, None])).T.copy()
        key = prefix[np.minimum(start + length, len(prefix) - 1)]
        key -= prefix[np.maximum(start, 0)]
        key *= scale
        key ^= salt
        key = key.T.copy()
        for i, at in enumerate(d.tolist()):
            ok = np.flatnonzero(fits[i])
            if len(ok):
                yield at, ok, key[i] if len(ok) == len(trig) else key[i][ok]


def _shared_windows(group: np.ndarray, place: np.ndarray, column: pa.Array, length: int, trigger: int) -> list[tuple[int, int, int]]:
    """(index, from, to): stretches of surroundings, relative to their first byte, covered by windows that another of the
    same group has at the same offset from its trigger. place: the trigger's offset in each."""
    hit = np.zeros((length - trigger + 1, len(group)), bool)
    for d, ok, key in _window_keys(group, place, column, length, trigger):
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        hit[d, ok[order[1:][same]]] = True
        hit[d, ok[order[:-1][same]]] = True
    out = []
    wide = np.zeros((len(group), len(hit) + 2), bool)  # a place to either side of each one's windows
    wide[:, 1:-1] = hit.T
    i0, d0 = np.nonzero(wide[:, 1:] & ~wide[:, :-1])
    _, d1 = np.nonzero(wide[:, :-1] & ~wide[:, 1:])
    for i, first, last in zip(i0.tolist(), d0.tolist(), (d1 - 1).tolist(), strict=True):
        out.append((i, int(place[i]) - last, int(place[i]) - first + length))
    return out


def _compare(found: DataFrame, length: int, trigger: int) -> DataFrame:
    """Covered stretches (row, lo, hi) of lone surroundings. found is sorted by gram within partitions."""

    def run(batches):
        held: list[pa.Table] = []

        def work(t: pa.Table):
            gram = t.column("gram").to_numpy()
            at, lo = t.column("at").to_numpy().astype(np.int64), t.column("lo").to_numpy().astype(np.int64)
            lone = t.column("lone").to_numpy(zero_copy_only=False)
            got = [x for x in _shared_windows(gram, at - lo, t.column("bytes").combine_chunks(), length, trigger) if lone[x[0]]]
            if got:
                i, a, z = (np.array(x, np.int64) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(pa.array(i)), pa.array(lo[i] + a), pa.array(lo[i] + z)], ["row", "lo", "hi"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < AT_ONCE:
                continue
            t = pa.concat_tables(held)
            gram = t.column("gram").to_numpy()
            whole = int(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[-1])
            if whole:
                yield from work(t.slice(0, whole))
                t = t.slice(whole)
            held[:] = [t]
        if held:
            yield from work(pa.concat_tables(held))

    return found.select("row", "at", "lo", "gram", "lone", "bytes").mapInArrow(run, "row binary, lo long, hi long")


def _ranges(length: int, trigger: int) -> list[tuple[int, int]]:
    """Windows before a trigger by the distance of their start, in RANGES stretches."""
    n = length - trigger + 1
    step = -(-n // RANGES)
    return [(r, min(r + step, n)) for r in range(0, n, step)]


def _cores_and_hulls(found: DataFrame, length: int, trigger: int) -> DataFrame:
    """row, at, lone, r0, r1, core, hull for every range with a window inside the surroundings: keys of the bytes that all of
    the range's windows share, and of all their bytes together (null if not all are inside)."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                t = pa.Table.from_batches([batch.slice(i, 500)])
                at, lo = t.column("at").to_numpy().astype(np.int64), t.column("lo").to_numpy().astype(np.int64)
                place = at - lo
                b = next(blocks(t.column("bytes").combine_chunks(), 1 << 40))
                prefix, trig, end = b.prefix(SAME), b.offs[:-1] + place, b.offs[1:]
                salt = mix(t.column("gram").to_numpy().view(U64))
                for r0, r1 in _ranges(length, trigger):
                    ok = np.flatnonzero((place >= r0) & (trig - (r1 - 1) + length <= end))
                    if not len(ok):
                        continue
                    core = mix(Block.span(prefix, trig[ok] - r0, trig[ok] - (r1 - 1) + length) ^ salt[ok] ^ U64(2 * r0 + 1))
                    whole = (place[ok] >= r1 - 1) & (trig[ok] - r0 + length <= end[ok])
                    low, high = np.where(whole, trig[ok] - (r1 - 1), 0), np.where(whole, trig[ok] - r0 + length, 0)
                    hull = mix(Block.span(prefix, low, high) ^ salt[ok] ^ U64(2 * r0 + 2))
                    n, take = len(ok), pa.array(ok)
                    yield pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(take), pa.array(at[ok]), t.column("lone").combine_chunks().take(take), pa.array(np.full(n, r0)), pa.array(np.full(n, r1)), pa.array(core.view(np.int64)), pa.array(hull.view(np.int64), mask=~whole)], ["row", "at", "lone", "r0", "r1", "core", "hull"])

    return found.select("row", "at", "lo", "gram", "lone", "bytes").mapInArrow(run, "row binary, at long, lone boolean, r0 long, r1 long, core long, hull long")


def _windows(asked: DataFrame, length: int, trigger: int) -> DataFrame:
    """asked: row, at, lo, gram, bytes, wanted (array of r0, told). row, told, at, lo, key: every window of the ranges wanted."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                t = pa.Table.from_batches([batch.slice(i, 500)])
                at, lo = t.column("at").to_numpy().astype(np.int64), t.column("lo").to_numpy().astype(np.int64)
                told = np.full((RANGES, len(at)), -1)
                ranges = _ranges(length, trigger)
                of = {r0: k for k, (r0, _) in enumerate(ranges)}
                for j, wanted in enumerate(t.column("wanted").to_pylist()):
                    for w in wanted:
                        told[of[w["r0"]], j] = max(told[of[w["r0"]], j], w["told"])
                step = ranges[0][1]
                asked_for = (told >= 0).any(1)
                which, back, keys = [], [], []
                for d, ok, key in _window_keys(t.column("gram").to_numpy(), at - lo, t.column("bytes").combine_chunks(), length, trigger):
                    if not asked_for[d // step]:
                        continue
                    on = told[d // step, ok] >= 0
                    which.append(ok[on])
                    back.append(np.full(len(which[-1]), d))
                    keys.append(mix(mix(key[on]) ^ U64(d)))
                if not which:
                    continue
                ok, d, key = np.concatenate(which), np.concatenate(back), np.concatenate(keys)
                # one batch for all distances: a batch for each costs more than its windows
                yield pa.RecordBatch.from_arrays([t.column("row").combine_chunks().take(pa.array(ok)), pa.array(told[d // step, ok] > 0), pa.array(at[ok]), pa.array(at[ok] - d), pa.array(key.view(np.int64))], ["row", "told", "at", "lo", "key"])

    return asked.select("row", "at", "lo", "gram", "bytes", "wanted").mapInArrow(run, "row binary, told boolean, at long, lo long, key long")


def _narrow(found: DataFrame, length: int, trigger: int) -> tuple[DataFrame, list[DataFrame]]:
    """The same as _compare, for triggers with many surroundings, by shuffles of a few keys a surrounding; and the tables that
    it reads. Windows that two surroundings share lie in a range whose core they share, so other ranges are done with. A
    range whose hull is shared is covered as a whole. Only what is left, ranges at the edges of shared text, is compared window
    by window; surroundings of one shared hull are alike there, and one stands for all."""
    ranges = materialize(_cores_and_hulls(found, length, trigger), "ranges")
    shared = ranges.select(F.explode(F.array("core", "hull")).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared.select("key"), "shared-ranges")
    kept = ranges.join(shared.withColumnRenamed("key", "core"), "core")
    kept = materialize(kept.join(shared.select(F.col("key").alias("hull"), F.lit(True).alias("whole")), "hull", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), "kept-ranges")
    spans = kept.where("lone and whole").select("row", (F.col("at") - F.col("r1") + 1).alias("lo"), (F.col("at") - F.col("r0") + length).alias("hi"))
    edge = kept.where("not whole").select("core", "row", "at", "r0", F.col("lone").cast("int").alias("told"))
    one = kept.where("whole").groupBy("hull").agg(F.min(F.struct("core", "row", "at", "r0")).alias("x")).select("x.*", F.lit(0).alias("told"))
    asked = edge.unionByName(one).join(edge.where("told = 1").select("core").distinct(), "core")
    wanted = asked.groupBy("row", "at").agg(F.collect_list(F.struct("r0", "told")).alias("wanted"))  # a few of one surrounding
    windows = materialize(_windows(found.join(wanted, ["row", "at"]), length, trigger), "edge-windows")
    twice = windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    hit = windows.where("told").join(twice, "key")
    run_of = F.col("lo") - F.row_number().over(Window.partitionBy("row", "at").orderBy("lo"))  # a trigger's windows
    runs = hit.withColumn("run", run_of).groupBy("row", "at", "run").agg(F.min("lo").alias("lo"), (F.max("lo") + length).alias("hi"))
    release(ranges, shared)
    return spans.unionByName(runs.select("row", "lo", "hi")), [kept, windows]


def repeated_spans(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, group: int = GROUP) -> DataFrame:
    """rows: row binary, text (and what else). (row, lo, hi), written: byte stretches covered by repeated strings; they may overlap."""
    seen = materialize(occurrences(rows, length, trigger), "triggers")
    kinds = seen.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "hi")).alias("one"))
    per = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1")
    kinds = materialize(kinds.join(per, "gram"), "surroundings")
    twins = seen.join(kinds.where("n > 1").select("gram", "around"), ["gram", "around"])
    spans = twins.select("row", F.greatest(F.col("at") - (length - trigger), F.lit(0)).cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    some = kinds.where("kinds > 1").select("one.*", "gram", (F.col("n") == 1).alias("lone"), (F.col("kinds") > group).alias("many"))
    cut = materialize(_fetch(rows, some, length, trigger), "cut")
    few = cut.where("not many").repartition("gram").sortWithinPartitions("gram")
    more, held = _narrow(cut.where("many").withColumn("at", F.col("at").cast("long")), length, trigger)
    spans = spans.unionByName(_compare(few, length, trigger)).unionByName(more)
    out = materialize(spans.where("hi > lo"), "spans")
    release(seen, kinds, cut, *held)  # the final join takes room for the texts
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes, as binary), for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.substring(F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("v"), "text"), F.lit("n"))))), 1, 12))
    spans = repeated_spans(rows, length)
    per = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))  # a row's own bytes bound it
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for s in spans or ():
                    if s["lo"] > end:
                        runs += 1
                    if s["hi"] > at:
                        kept.append(data[at : max(at, s["lo"])])
                        removed += s["hi"] - max(at, s["lo"])
                        at = s["hi"]
                    end = max(end, s["hi"])
                kept.append(data[at:])
                left = b"".join(kept)
                out.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.join(per, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
