"""Structured Streaming forms: continuous ingest of metric rows, and live events of late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenlake.operators.decide import Thresholds, decide
from lumenlake.operators.mutate import latest
from lumenlake.shared import materialize, release
from lumenlake.sources.tables import Catalog, Change

VERDICTS = "image_id long, verdict string, stars int, label string, reasons array<string>, warnings array<string>, score double, user_override boolean"


def ingest(rows: DataFrame, catalog: Catalog, checkpoint: str, t: Thresholds = Thresholds(), once: bool = True) -> StreamingQuery:
    """rows: a stream of metrics with image_id and mtime. Each batch takes the newest row an image, decides it and upserts
    the tables metrics and verdicts, both or neither, writing no more than its own rows; a batch that runs again after a failure
    gives the same tables. Verdicts set by hand stay."""
    schema = _ddl(rows.schema)

    def save(batch: DataFrame, number: int) -> None:
        new = latest(batch, "image_id", "mtime")
        known = catalog.find("metrics", new, schema).select("image_id", F.col("mtime").alias("known"))
        new = materialize(new.join(known, "image_id", "left").where("known is null or mtime > known").drop("known"), "batch")
        by_hand = catalog.find("verdicts", new, VERDICTS).where(F.coalesce("user_override", F.lit(False)))
        verdicts = decide(new, t).join(by_hand, "image_id", "left_anti").withColumn("user_override", F.lit(False))
        catalog.commit({"metrics": Change(new), "verdicts": Change(verdicts)})
        release(new)

    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def live_events(rows: DataFrame, key: str, gap: int = 6 * 3600, late: str = "1 day", time_col: str = "ts") -> DataFrame:
    """key, start, end, n: an event ends where the key's next row is more than gap seconds away. Rows later than the watermark
    are dropped; append mode gives an event once the watermark has passed its end."""
    told = rows.withWatermark(time_col, late)
    spans = told.groupBy(key, F.session_window(time_col, f"{gap} seconds")).agg(F.count("*").alias("n"), F.min(time_col).alias("start"), F.max(time_col).alias("end"))
    return spans.select(key, "start", "end", "n")


def live_members(rows: DataFrame, key: str, gap: int = 6 * 3600, late: str = "1 day", time_col: str = "ts", id_col: str = "id") -> DataFrame:
    """key, id, event_no: members of each key's events, numbered from 0 as split_by_key numbers them, in append mode.

    A row is told once the watermark has passed its time, when nothing before it can come any more; until then it waits in its
    key's state, with the last told time and the number reached. A timer at the earliest waiting time wakes keys without new
    rows. Rows later than the watermark are dropped, and rows without a time; ties go by id, and a null key is a key."""
    kind = dict(rows.dtypes)[key]
    timed = rows.where(F.col(time_col).isNotNull()).withWatermark(time_col, late)
    own = timed.select(key, F.col(id_col).cast("long").alias("_id"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("_t"), time_col)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, number, times, ids = state.get if state.exists else (None, 0, [], [])
        waiting = list(zip(times, ids, strict=True))
        for f in frames:
            waiting += zip(f["_t"].tolist(), f["_id"].tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000 + 999
        told = 0
        out: list[tuple[int, int]] = []
        while told < len(waiting) and waiting[told][0] <= passed:
            t, own_id = waiting[told]
            number += last is not None and t - last > gap * 1_000_000
            last = t
            out.append((own_id, number))
            told += 1
        waiting = waiting[told:]
        state.update((last, number, [t for t, _ in waiting], [i for _, i in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, passed // 1000 + 1))
        yield pd.DataFrame({key: [name[0]] * len(out), id_col: [i for i, _ in out], "event_no": [n for _, n in out]})

    held = "last long, number long, times array<long>, ids array<long>"
    return own.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{id_col}` long, event_no long", held, "append", GroupStateTimeout.EventTimeTimeout)
