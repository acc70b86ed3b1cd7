"""Cells of vectors about sampled pivots, and exact searches that leave out what the angles rule out.

A bounded sample of the rows, at most PIVOTS, are pivots; every row belongs to the nearest one, and to a ring about it by its
angle. A cell is a pivot's ring, and knows the least and the largest angle of its rows. Angles obey the triangle inequality,
so a vector at an angle to the pivot is no nearer to any row of the cell than that angle is to the ring's: it is multiplied
only by cells that this lets in, so the answer does not depend on the sample; on vectors without any clusters every cell is
let in, and all pairs are multiplied. Rows without a direction (all zeros) have a cosine of 0 with all and a cell of their own
that is open to everything.

Rows do not travel to the cells that let them in. Rows of neighbouring cells are packed once into blocks, one row of a table
each, which names the blocks that it must meet; a Cartesian product then reads that table from the shared folder on both
sides, so that shuffles and writes grow as the rows do, whatever is let in. A task meets two of the table's scan partitions,
PARTS or fewer, whose number does not grow with the rows, and holds one of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.shared import materialize, release

PIVOTS, CELL_ROWS = 2048, 2000
#: rows of a block, and of it that are multiplied at once; files of a table of blocks
BLOCK, TILE, PARTS = 4096, 512, 32
#: radians by which rounding may move an angle
SLACK = 1e-6
#: width of a ring in radians, and how many a pivot has
RING, RINGS = 0.2, 16
#: rows whose bounds on all cells are held at once
AT_ONCE = 512


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def stacked(column: pd.Series) -> np.ndarray:
    return unit(np.stack(column.to_numpy()).astype(np.float64))


def _listed(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of every row to every pivot; rows without a direction: 0, as any bound on them must let everything in."""
    out = np.arccos(np.clip(unit(rows) @ pivots.T, -1, 1))
    out[np.linalg.norm(rows, axis=1) < 1e-12] = 0
    return out


@dataclass(frozen=True)
class Cells:
    """rows: id, embedding, cell; of each cell that has rows its number (rising), pivot, least and largest angle, and rows."""

    rows: DataFrame
    pivots: np.ndarray
    number: np.ndarray
    pivot_of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray

    def release(self) -> None:
        release(self.rows)


def cells(vectors: DataFrame, cell_rows: int = CELL_ROWS) -> Cells:
    """vectors: id, embedding; rows without an embedding are left out. The pivots are the rows of the least hashes of id."""
    rows = vectors.where("embedding is not null").select("id", "embedding")
    wanted = min(PIVOTS, max(1, math.ceil(rows.count() / cell_rows)))
    sample = [r["embedding"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()]
    pivots = np.unique(unit(np.array(sample, np.float64)), axis=0) if sample else np.zeros((0, 1))
    sent = rows.sparkSession.sparkContext.broadcast(pivots)
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                m = _listed(batch.column(1))
                a = angles(m, sent.value)
                own = a.argmin(1)
                angle = a[np.arange(len(m)), own]
                cell = own * RINGS + np.minimum(angle / RING, RINGS - 1).astype(np.int64)
                cell[np.linalg.norm(m, axis=1) < 1e-12] = len(sent.value) * RINGS
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], ["id", "embedding", "cell", "angle"])

    held = materialize(rows.mapInArrow(run, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int, angle double"), "cells")
    sent.destroy()
    known = held.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell").toPandas()  # RINGS rows a pivot at most
    number = known["cell"].to_numpy(np.int64)
    bare = number == len(pivots) * RINGS
    low, high = np.where(bare, 0, known["low"]), np.where(bare, 7, known["high"])
    return Cells(held, pivots, number, np.where(bare, 0, number // RINGS), low.astype(float), high.astype(float), known["n"].to_numpy(np.int64))


def least_angles(a: np.ndarray, pivot_of: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least angle that rows at these angles to the pivots can have to any row of each cell."""
    own = a[:, pivot_of]
    return np.maximum(np.maximum(own - high, low - own), 0)


def _numbered(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Of cells in order their first block and how many blocks they have: small neighbours share one, large cells are split."""
    first, parts, last, room = np.zeros(len(sizes), np.int64), (sizes > 0).astype(np.int64), -1, 0
    for k, n in enumerate(sizes.tolist()):
        if n > room:
            first[k], parts[k] = last + 1, math.ceil(n / block)
            last, room = last + int(parts[k]), block - n if n <= block else 0
        else:
            first[k], room = last, room - n
    return first, parts


def _least(m: np.ndarray, to: tuple[np.ndarray, ...]) -> np.ndarray:
    """The least angles of rows to all cells of (pivots, pivot_of, low, high); 0 for rows without a direction."""
    least = least_angles(angles(m, to[0]), *to[1:])
    least[np.linalg.norm(m, axis=1) < 1e-12] = 0
    return least


def placed(rows: DataFrame, to: Cells) -> DataFrame:
    """rows (id, embedding) with cell: the nearest of the cells that have rows."""
    kinds, number, shape = dict(rows.dtypes), to.number, (to.pivots, to.pivot_of, to.low, to.high)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows if len(number) else 0, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                cell = number[_least(_listed(batch.column(1)), shape).argmin(1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["id", "embedding", "cell"])

    return rows.select("id", "embedding").mapInArrow(run, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int")


@dataclass(frozen=True)
class Packing:
    """A table (id, embedding, cell) in blocks by its own sizes: of each cell of `to` the first block and how many."""

    first: np.ndarray
    parts: np.ndarray

    def held_by(self, cells: np.ndarray) -> np.ndarray:
        """The blocks that hold rows of these cells (places in to.number)."""
        n = self.parts[cells]
        return np.unique(np.repeat(self.first[cells], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def packing(to: Cells, block: int, rows: DataFrame | None = None) -> Packing:
    """For rows (with cell), or the cells' own."""
    if rows is None:
        return Packing(*_numbered(to.sizes, block))
    met = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row a cell
    return Packing(*_numbered(np.array([met.get(c, 0) for c in to.number.tolist()], np.int64), block))


def packed(rows: DataFrame, to: Cells, by: Packing, meets: Callable[[int, np.ndarray, Callable[[], np.ndarray]], np.ndarray] | None = None, links: float | None = None, behind: bool = False) -> DataFrame:
    """rows: id, embedding, cell, and most (the largest angle at which a row is wanted) if they meet others. A row a block,
    written: block, id, cell, vectors, most, root (bytes), probes. meets gets a block's number, the places of its cells and a
    function for the places of the cells that are let in, and gives the blocks to be met. root: of each row the least place of the
    block that its component has, by pairs with a cosine of links or more, or by the column component. behind: the numbers are
    below zero."""
    spark = rows.sparkSession
    shape, number = (to.pivots, to.pivot_of, to.low, to.high), to.number
    of = spark.createDataFrame([(int(c), int(f), int(n)) for c, f, n in zip(number, by.first, by.parts, strict=True)], "cell int, first int, parts int")
    block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    wide = rows if "most" in rows.columns else rows.withColumn("most", F.lit(7.0))
    known = ["component"] * ("component" in rows.columns)
    numbered = wide.join(F.broadcast(of), "cell").select((-1 - block if behind else block).alias("block"), F.col("id").cast("long").alias("id"), "cell", "embedding", "most", *known)  # a row a cell

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cell").combine_chunks()
        k, most = np.searchsorted(number, t.column("cell").to_numpy()), t.column("most").to_numpy()
        m = t.column("embedding").combine_chunks()
        flat, no = m.flatten().to_numpy(zero_copy_only=False), t.column("block")[0].as_py()

        def reach() -> np.ndarray:
            wide, any_row = flat.astype(np.float64).reshape(len(m), -1), np.zeros(len(number), bool)
            for at in range(0, len(m), AT_ONCE):
                any_row |= (_least(wide[at : at + AT_ONCE], shape) <= most[at : at + AT_ONCE, None]).any(0)
            return np.flatnonzero(any_row)

        root = np.zeros(0, np.int64)
        if known:
            _, first, of_row = np.unique(t.column("component").to_numpy(), return_index=True, return_inverse=True)
            root = first[of_row]
        elif links is not None:
            u, root = unit(flat.astype(np.float64).reshape(len(m), -1)), np.arange(len(m))
            for at in range(0, len(m), TILE):
                i, j = np.nonzero(u[at : at + TILE] @ u[at:].T >= links)
                root = joined_labels(root, i + at, j + at)
        probes = meets(no, np.unique(k), reach) if meets else np.zeros(0, int)
        values = [[no], [t.column("id").to_numpy().tobytes()], [k.astype(np.int32).tobytes()], [flat.tobytes()], [most.tobytes()], [root.astype(np.int32).tobytes()], [probes.tolist()]]
        return pa.table([pa.array(v, f.type) for v, f in zip(values, BLOCKS, strict=True)], schema=BLOCKS)

    return materialize(numbered.repartition(PARTS, "block").groupBy("block").applyInArrow(run, "block int, id binary, cell binary, vectors binary, most binary, root binary, probes array<int>"), "blocks")


BLOCKS = pa.schema([("block", pa.int32()), ("id", pa.binary()), ("cell", pa.binary()), ("vectors", pa.binary()), ("most", pa.binary()), ("root", pa.binary()), ("probes", pa.list_(pa.int32()))])


@dataclass(frozen=True)
class Block:
    number: int
    ids: np.ndarray
    cells: np.ndarray
    unit: np.ndarray
    bare: np.ndarray
    most: np.ndarray
    root: np.ndarray


def _block(batch: pa.RecordBatch, i: int, side: str, kind: type) -> Block:
    raw = lambda c, t: np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), t)
    ids = raw("id", np.int64)
    m = raw("vectors", kind).astype(np.float64).reshape(len(ids), -1)
    return Block(batch.column(f"{side}_block")[i].as_py(), ids, raw("cell", np.int32), unit(m), np.linalg.norm(m, axis=1) < 1e-12, raw("most", np.float64), raw("root", np.int32))


def meetings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every block of left beside each block of right that it probes, of two tables that packed wrote."""
    side = lambda t, s: t.select(*[F.col(c).alias(f"{s}_{c}") for c in t.columns])
    met = side(left, "l").join(side(right.drop("probes"), "r").hint("shuffle_replicate_nl"), F.array_contains("l_probes", F.col("r_block")))  # blocks, read where they lie
    return met.drop("l_probes")


def tiles(batches, to: tuple[np.ndarray, ...], kinds: tuple[type, type], whole: bool = False) -> Iterator[tuple[Block, Block, np.ndarray, int, np.ndarray]]:
    """Of each meeting: the blocks, places of rows of the left one, the place of the first of some rows of the right one, and
    the cosines of these, which leave out only what the bounds of (pivots, pivot_of, low, high) rule out; whole: nothing."""
    pivots, pivot_of, low, high = to
    x = None
    for batch in batches:
        for n in range(batch.num_rows):
            if x is None or x.number != batch.column("l_block")[n].as_py():
                x = _block(batch, n, "l", kinds[0])
            y = _block(batch, n, "r", kinds[1])
            edge = np.flatnonzero(np.concatenate([[True], y.cells[1:] != y.cells[:-1], [True]]))
            of = y.cells[edge[:-1]]
            near, at = np.unique(pivot_of[of], return_inverse=True)
            a = np.arccos(np.clip(x.unit @ pivots[near].T, -1, 1))
            ok = (least_angles(a, at, low[of], high[of]) <= x.most[:, None]) | x.bare[:, None]
            some = [(np.arange(len(x.ids)), 0, len(y.ids))] if whole or ok.all() else [(np.flatnonzero(ok[:, c]), edge[c], edge[c + 1]) for c in range(len(of))]
            for rows, start, end in some:
                for i in range(0, len(rows), TILE):
                    part = rows[i : i + TILE]
                    yield x, y, part, start, x.unit[part] @ y.unit[start:end].T


def kind_of(rows: DataFrame) -> type:
    """Of the numbers of an embedding, as blocks hold them."""
    return np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64


def compared(left: DataFrame, right: DataFrame, to: Cells, kinds: tuple[type, type], found: Callable[[Block, Block, np.ndarray, int, np.ndarray], list[np.ndarray]], schema: str) -> DataFrame:
    """The columns that found gives for each of the tiles."""
    shape, names = (to.pivots, to.pivot_of, to.low, to.high), [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for tile in tiles(batches, shape, kinds):
            columns = found(*tile)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return meetings(left, right).mapInArrow(run, schema)


def widest(threshold: float) -> float:
    """The largest angle of two vectors with a cosine of the threshold or more; any, if rows without a direction (0) count."""
    return 7.0 if threshold <= 0 else math.acos(min(1.0, threshold)) + SLACK


def among(to: Cells, threshold: float, block: int) -> DataFrame:
    """The cells' rows in blocks that meet those of their own and higher numbers, as a pair needs to be met once."""
    by = packing(to, block)

    def meets(no: int, own: np.ndarray, reach: Callable[[], np.ndarray]) -> np.ndarray:
        got = by.held_by(reach())
        return got[got >= no]

    return packed(to.rows.select("id", "embedding", "cell").withColumn("most", F.lit(widest(threshold))), to, by, meets)


def linked(to: Cells, new: DataFrame, old: DataFrame | None, threshold: float, block: int) -> tuple[DataFrame, DataFrame | None]:
    """new rows (id, embedding, cell) in blocks with the roots of what their own pairs link, which meet later ones of them and
    the blocks of old rows (and component, never null), whose roots are of their components."""
    by, before = packing(to, block, new), old is not None and packing(to, block, old)

    def meets(no: int, own: np.ndarray, reach: Callable[[], np.ndarray]) -> np.ndarray:
        cells = reach()
        got = by.held_by(cells)
        return np.concatenate([got[got > no], -1 - before.held_by(cells) if before else got[:0]])

    left = packed(new.withColumn("most", F.lit(widest(threshold))), to, by, meets, links=threshold)
    return left, packed(old, to, before, behind=True) if before else None


def towards(rows: DataFrame, to: Cells, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """rows (id, embedding) in blocks, and the cells' rows in blocks that they must meet."""
    by, given = packing(to, block), materialize(placed(rows, to), "placed")
    left = packed(given.withColumn("most", F.lit(widest(threshold))), to, packing(to, block, given), lambda no, own, reach: by.held_by(reach()))
    release(given)
    return left, packed(to.rows.select("id", "embedding", "cell"), to, by)


def within(to: Cells, threshold: float) -> DataFrame:
    """id, own (cell) and probe: the cells that each of the cells' rows may be near to, later ones only: what is multiplied, for
    multiplied, but for blocks whose cells are all let in."""
    most, number, shape = widest(threshold), to.number, (to.pivots, to.pivot_of, to.low, to.high)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                own = batch.column(2).to_numpy()
                row, cell = np.nonzero((number[None] >= own[:, None]) & (_least(_listed(batch.column(1)), shape) <= most))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(own[row]), pa.array(number[cell].astype(np.int32))], ["id", "own", "probe"])

    return to.rows.select("id", "embedding", "cell").mapInArrow(run, f"id {dict(to.rows.dtypes)['id']}, own int, probe int")


def multiplied(probes: DataFrame, to: Cells) -> DataFrame:
    """rows, cells and multiplied: how many of the pairs of a row and a row that it may meet are multiplied, as a share."""
    n = int(to.sizes.sum())
    size = probes.sparkSession.createDataFrame([(int(c), float(x)) for c, x in zip(to.number, to.sizes, strict=True)], "probe int, size double")
    return probes.join(F.broadcast(size), "probe").agg(F.lit(n).alias("rows"), F.lit(len(to.sizes)).alias("cells"), (F.sum("size") / (n * (n + 1) / 2)).alias("multiplied"))  # a row a cell


def joined_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of a spanning forest (each the least place of its tree) after the edges i, j; labels point at roots."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(labels, deeper := labels[labels]):
            labels = deeper
