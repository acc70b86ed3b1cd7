"""Pairs of 64-bit values that differ in a few bits, exactly, by covering masks.

For r bits, give every bit position a vector of r + 1 bits and take, for each non-zero v of r + 1 bits, the mask of positions
whose vectors have an odd product with v. At most r vectors are orthogonal to some v, so two values that differ in r positions
at most agree under one of the 2**(r + 1) - 1 masks (covering hashing: Pagh, SODA 2016). Each mask keeps about half of the
bits; values that agree under it are compared. A part of the bits, with its share of the radius, needs far fewer masks, but
keeps fewer bits: the ways below differ in that, and each scope (values that are to meet one another at all) takes the one
that costs least at its number of values, so that the pairs compared grow about with the values:

- all: one empty mask, everything in the scope is compared;
- halves: one half differs in r // 2 bits at most, or the other in what is then left;
- thirds: two of three thirds differ in two thirds of the radius at most;
- whole: the radius of all bits.

A group, a mask and a bucket of what it keeps, is sorted by that, and runs are compared. A pair is kept under one mask only:
that of its least v, which is told from the pair alone. Groups that hold more than CAP values, as many values may agree under a
mask, are split into blocks that meet pair by pair. Pairs that agree in a whole part fall to its first mask alone, so its
groups are FINE times as many.

Under the one mask of `all` values travel to their group in binary chunks. Under many masks they do not travel: they are packed
once, and a Cartesian product of that table with the groups reads it from the shared folder, so that what is written is one copy
of the values, whatever the number of masks.

near_pairs gives every pair, AT_ONCE at a time, a value's own pairs one after another. near_links is for components: dense values have very many pairs, so it first
joins values that agree outside a window of r bits, and then looks only for links between what is not joined yet; a group
gives a spanning forest of those.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.graph import components
from lumenlake.operators.cells import joined_labels
from lumenlake.shared import materialize

U64 = np.uint64
#: nanoseconds that a value costs under a mask, and a pair compared
KEY_COST, PAIR_COST = 150.0, 10.0
#: values of a group, and of one under the empty mask, at which it is dealt to more buckets; how many groups a part's first mask
#: has for one of another mask; values that a task holds, and tasks for few values; values of a packed row, and files of these
CAP, CAP_ALL, FINE, HELD, TASKS, PACKED, FILES = 2_000_000, 50_000, 32, 2_000_000, 32, 50_000, 8
#: pairs that a group holds before it hands them on; values of a run from which it is searched by stars; scopes that follow one
#: another and meet in one group, as a power of two
AT_ONCE, LONG, BESIDE = 1_000_000, 32, 6
#: pairs that are compared at once
COMPARED = 1 << 18
TRIES = 64
WAYS = ("all", "halves", "thirds", "whole")


@dataclass(frozen=True)
class Part:
    """Bits of a value, the radius within them, and the masks of v = 1, 2, ..."""

    bits: int
    radius: int
    masks: np.ndarray


@lru_cache(maxsize=64)
def _covered(bits: int, radius: int) -> Part:
    """The masks of a part: of TRIES seeded draws of the positions' vectors those that let the fewest random values meet."""
    places = np.flatnonzero([(bits >> i) & 1 for i in range(64)])
    v = np.arange(1, 1 << (radius + 1))
    rnd, best, least = np.random.default_rng(bits % 2**32 + radius), None, math.inf
    for _ in range(TRIES):
        odd = np.bitwise_count(rnd.integers(1, 1 << (radius + 1), len(places))[None] & v[:, None]) & 1
        chance = float((0.5 ** odd.sum(1)).sum())
        if chance < least:
            best, least = odd, chance
    masks = (best.astype(U64) << places.astype(U64)[None]).sum(1, dtype=U64)
    return Part(bits, radius, masks)


@lru_cache(maxsize=64)
def parts(way: str, radius: int) -> tuple[Part, ...]:
    whole = (1 << 64) - 1
    if way == "all":
        return (Part(whole, radius, np.zeros(1, U64)),)
    if way == "windows":
        at = sorted({*range(0, 64 - radius, max(1, radius // 2)), 64 - radius}) if radius else [0]
        return (Part(whole, radius, np.array([whole ^ (((1 << radius) - 1) << i) for i in at], U64)),)
    if way == "whole":
        return (_covered(whole, radius),)
    if way == "halves":
        half = (1 << 32) - 1
        second = radius - radius // 2 - 1
        return (_covered(half << 32, radius // 2), *([_covered(half, second)] if second >= 0 else []))
    thirds = [((1 << 22) - 1) << 42, ((1 << 21) - 1) << 21, (1 << 21) - 1]
    return tuple(_covered(whole ^ t, 2 * radius // 3) for t in thirds)


def cost(way: str, radius: int, n: float) -> float:
    """Of a scope of n random values."""
    masks = np.concatenate([p.masks for p in parts(way, radius)])
    met = float((0.5 ** np.bitwise_count(masks).astype(float)).sum()) * n * n / 2
    return len(masks) * n * KEY_COST * (way != "all") + met * PAIR_COST


@lru_cache(maxsize=16)
def limits(radius: int) -> tuple[tuple[int, str], ...]:
    """(values up to which a way costs least, the way), rising."""
    out: list[tuple[int, str]] = []
    for n in (1 << k for k in range(1, 48)):
        way = min(WAYS, key=lambda w: cost(w, radius, n))
        if out and out[-1][1] == way:
            out.pop()
        out.append((n, way))
    return tuple(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _bucket(s: np.ndarray, h: np.ndarray, mask: U64, buckets: int, beside: int = 0) -> np.ndarray:
    return (_mix((h & mask) ^ _mix((s >> U64(beside)) ^ U64(0x5851F42D4C957F2D))) % U64(buckets)).astype(np.int64)


def _block(h: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(h ^ U64(0x2545F4914F6CDD1D)) % U64(blocks)).astype(np.int64)


def _dealt(values: DataFrame, buckets: int) -> DataFrame:
    """Chunks of values that meet under the empty mask: bucket, scopes, found, nodes."""

    def run(batches):
        for batch in batches:
            s, h, node = (batch.column(c).to_numpy(zero_copy_only=False).view(U64) for c in (0, 1, 2))
            b = _bucket(s, h, U64(0), buckets, BESIDE)
            by = np.argsort(b, kind="stable")
            rows = [(int(b[x[0]]), s[x].tobytes(), h[x].tobytes(), node[x].tobytes()) for x in np.split(by, np.flatnonzero(np.diff(b[by])) + 1) if len(x)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "scopes", "found", "nodes"])

    return values.select("scope", "h", "node").mapInArrow(run, "bucket long, scopes binary, found binary, nodes binary")


def _packed(values: DataFrame) -> DataFrame:
    """values, PACKED of them a row, written to FILES files: scopes (one, if it is that of all), found, nodes."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False).view(U64) for c in (0, 1, 2)])
            n += batch.num_rows
            if n >= PACKED:
                yield row(held)
                held, n = [], 0
        if n:
            yield row(held)

    def row(held):
        s, h, node = (np.concatenate(x) for x in zip(*held, strict=True))
        s = s[:1] if (s == s[0]).all() else s
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (s, h, node)], ["scopes", "found", "nodes"])

    return materialize(values.select("scope", "h", "node").coalesce(FILES).mapInArrow(run, "scopes binary, found binary, nodes binary"), "packed")


@dataclass(frozen=True)
class Group:
    """About n values of one bucket under mask f of all parts; of a split group those of the blocks i and j."""

    n: int
    f: int
    bucket: int
    buckets: int
    i: int = 0
    j: int = 0
    blocks: int = 1


def _groups(packed: DataFrame, masks: np.ndarray, first: set[int], n: int) -> list[Group]:
    """All groups of n values; first: the first masks of parts."""
    most = {f: math.ceil(n / CAP) if f not in first else math.ceil(n * FINE / CAP) for f in range(len(masks))}
    cap = {f: CAP if f not in first else max(1, CAP // FINE) for f in most}
    dealt = [f for f, b in most.items() if b > 1]

    def sizes(batches):
        held = {f: np.zeros(most[f], np.int64) for f in dealt}
        for s, h, _ in _unpacked(batches):
            for f in dealt:
                held[f] += np.bincount(_bucket(s, h, masks[f], most[f]), minlength=most[f])
        for f, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f)), pa.array(at), pa.array(c[at])], ["f", "bucket", "n"])

    out = [Group(n, f, 0, 1) for f, b in most.items() if b == 1]
    if dealt:
        held = packed.mapInArrow(sizes, "f long, bucket long, n long").groupBy("f", "bucket").agg(F.sum("n").alias("n"))
        for f, bucket, count in held.orderBy("f", "bucket").collect():  # masks * FINE * values / CAP at most
            k = math.ceil(count / cap[f]) if count > 2 * cap[f] else 1
            out += [Group(count * (1 + (i < j)) // k, f, bucket, most[f], i, j, k) for i in range(k) for j in range(i, k)]
    return out


def _unpacked(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """Scopes, values and nodes of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            s, h, node = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in ("scopes", "found", "nodes"))
            yield np.full(len(h), s[0]) if len(s) < len(h) else s, h, node


def _task(batches, groups: list[Group], masks: np.ndarray, met) -> Iterator[pa.RecordBatch]:
    """What met gives for some groups, whose values are picked out as they come."""
    held: dict[Group | None, list[tuple[np.ndarray, ...]]] = {}  # None: all values
    for s, h, node in _unpacked(batches):
        f = bucket = None
        for g in groups:
            if g.buckets == 1:
                continue
            if f != g.f:
                f, bucket = g.f, _bucket(s, h, masks[g.f], g.buckets)
            at = np.flatnonzero(bucket == g.bucket)
            side = np.zeros(len(at), np.int64)
            if g.blocks > 1:
                block = _block(h[at], g.blocks)
                on = (block == g.i) | (block == g.j)
                at, side = at[on], (block[on] != g.i).astype(np.int64)
            held.setdefault(g, []).append((s[at], h[at], node[at], side))
        if any(g.buckets == 1 for g in groups):
            held.setdefault(None, []).append((s, h, node, np.zeros(len(h), np.int64)))
    whole = [np.concatenate(x) for x in zip(*held.pop(None, []), strict=True)]
    for g in groups:
        s, h, node, side = whole if g.buckets == 1 else (np.concatenate(x) for x in zip(*held.pop(g), strict=True))
        if len(h):
            yield from met(g.f, s, h, node, side if g.i != g.j else None)


def _read_where_it_lies(values: DataFrame, listed: tuple[Part, ...], n: int, met, schema: str) -> DataFrame:
    """What met gives for every group of n values under the parts' masks: a task reads the packed values for its groups."""
    masks = np.concatenate([p.masks for p in listed])
    first = {f for f, (_, v) in enumerate(_numbers(listed)) if v == 1}
    packed = _packed(values)
    groups = _groups(packed, masks, first, n)
    upto = np.cumsum([g.n * (FINE if g.f in first else 1) for g in groups], dtype=float)  # a first mask's have more pairs
    wanted = max(min(TASKS, len(groups)), math.ceil(upto[-1] / HELD))
    task = np.minimum((upto - upto[0]) / upto[-1] * wanted, wanted - 1).astype(int)
    tasks = [[groups[i] for i in at] for at in np.split(np.arange(len(groups)), np.flatnonzero(np.diff(task)) + 1)]

    def run(batches):
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is not None:
            yield from _task(chain([first_batch], batches), tasks[first_batch.column("task")[0].as_py()], masks, met)

    of = values.sparkSession.range(0, len(tasks), 1, len(tasks)).select(F.col("id").alias("task"))
    return packed.coalesce(1).hint("shuffle_replicate_nl").crossJoin(of).mapInArrow(run, schema)  # a task a number, which reads the few files


def _runs(s: np.ndarray, kept: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by scope, what the mask keeps and what the part keeps; where runs of the first two start; and the ends of runs
    of all three, for every value."""
    order = np.lexsort((part, kept, s))
    s, kept, part = s[order], kept[order], part[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (kept[1:] != kept[:-1])])
    equal = np.flatnonzero(new | np.concatenate([[True], part[1:] != part[:-1]]))
    return order, np.flatnonzero(new), np.repeat(np.append(equal[1:], len(s)), np.diff(np.append(equal, len(s))))


def _in_runs(s, h, node, side, part: Part, v: int, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Scope, both values and both nodes of the pairs within the radius that agree under mask v; with sides, across them only.
    Values that agree in the whole part are paired under its first mask alone, as no other is their least. Pairs come by their
    first value, which under the first mask has the lesser node: so they take little room."""
    order, new, equal_end = _runs(s, h & part.masks[v - 1], node if v == 1 else h & U64(part.bits))
    s, h, node, side = s[order], h[order], node[order], None if side is None else side[order]
    end = np.repeat(np.append(new[1:], len(h)), np.diff(np.append(new, len(h))))
    at = np.arange(len(h))
    other = at + 1 if v == 1 else equal_end
    on = np.flatnonzero(other < end)
    at, other, n = at[on], other[on], (end - other)[on]
    upto = np.cumsum(n)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - n[i] + COMPARED, "right")))
        c = n[i:j]
        before = np.cumsum(c) - c
        a, b = np.repeat(at[i:j], c), np.arange(c.sum()) + np.repeat(other[i:j] - before, c)
        hit = np.bitwise_count(h[a] ^ h[b]) <= radius
        hit = hit if side is None else hit & (side[a] != side[b])
        a, b = a[hit], b[hit]
        if len(a):
            yield s[a], h[a], h[b], node[a], node[b]
        i = j


def _least(z: np.ndarray, part: Part, v: int) -> np.ndarray:
    """Whether v is the least whose mask has no bit of the differences z: all lesser ones have, up to its leading bit."""
    lead = 1 << (v.bit_length() - 1)
    out = np.ones(len(z), bool)
    for w in part.masks[: lead - 1]:
        out &= (z & w) != 0
    return out


def _numbers(listed: tuple[Part, ...]) -> list[tuple[int, int]]:
    return [(p, v) for p, part in enumerate(listed) for v in range(1, len(part.masks) + 1)]


def _meeting(listed: tuple[Part, ...], radius: int, rows_of: Callable[..., list[np.ndarray]], names: list[str]):
    """The pairs of one group, across sides if these are given, as rows_of(scope, a, b, node of a, node of b) has them."""
    numbers = _numbers(listed)

    def met(f: int, s: np.ndarray, h: np.ndarray, node: np.ndarray, side: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        p, v = numbers[f]
        part = listed[p]
        held, n = [], 0
        for s, a, b, x, y in _in_runs(s, h, node, side, part, v, radius):
            z = a ^ b
            ok = np.ones(len(z), bool)
            for earlier in listed[:p]:
                ok &= np.bitwise_count(z & U64(earlier.bits)) > earlier.radius
            if len(part.masks) > 1:
                own = z & U64(part.bits)
                near = np.bitwise_count(own)
                ok &= (near <= part.radius) & (near >= v.bit_length() - 1)
                at = np.flatnonzero(ok)
                ok[at] = _least(own[at], part, v)
            held.append(rows_of(s[ok], a[ok], b[ok], x[ok], y[ok]))
            n += int(ok.sum())
            if n >= AT_ONCE:
                yield _batch(held, names)
                held, n = [], 0
        if n:
            yield _batch(held, names)

    return met


def _batch(held: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)


def _stars(h: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what near pairs of the values join, of labels that may be joined already. Values within the radius of a
    leader are its star; a value that is near to one of a star is within twice the radius of its leader."""
    src, dst, leaders, members, left = [], [], [], [], np.arange(len(h))
    group = label.copy()

    def join(c: int, others: np.ndarray) -> None:
        src.append(np.full(len(others), c))
        dst.append(others)
        group[np.isin(group, group[others])] = group[c]

    while len(left):
        near = np.bitwise_count(h[left] ^ h[left[0]]) <= radius
        leaders.append(left[0])
        members.append(left[near])
        left = left[~near]
        apart = members[-1][group[members[-1]] != group[leaders[-1]]]
        if len(apart):
            join(leaders[-1], apart)
    for c, own in zip(leaders, members, strict=True):
        other = np.flatnonzero(group != group[c])
        if not len(other):
            break
        other = other[np.bitwise_count(h[other] ^ h[c]) <= 2 * radius]
        width = max(1, AT_ONCE // len(own))
        for i in range(0, len(other), width):
            some = other[i : i + width]
            hit = some[(np.bitwise_count(h[some][:, None] ^ h[own][None]) <= radius).any(1)]
            if len(hit):
                join(c, hit)
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least node and each other of the trees that edges between places of node make."""
    nodes, at = np.unique(node, return_inverse=True)
    label = joined_labels(np.arange(len(nodes)), at[i], at[j])
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def _joining(listed: tuple[Part, ...], radius: int, whole: bool = False):
    """src, dst: a spanning forest of what one group joins. whole: all values of a run are near one another."""
    numbers = _numbers(listed)

    def met(f: int, s: np.ndarray, h: np.ndarray, node: np.ndarray, side: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        p, v = numbers[f]
        node = node.view(np.int64)
        kept = h & listed[p].masks[v - 1]
        order, new, _ = _runs(s, kept, h)
        h, node, end = h[order], node[order], np.append(new[1:], len(h))
        open_ = np.minimum.reduceat(node, new) != np.maximum.reduceat(node, new)  # runs of one label have nothing to join
        new, end = new[open_], end[open_]
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if whole:
            n = end - new
            src, dst = [np.repeat(new, n)], [np.arange(n.sum()) + np.repeat(new - (np.cumsum(n) - n), n)]
        else:
            long = end - new >= LONG
            for a, b in zip(new[long], end[long], strict=True):
                i, j = _stars(h[a:b], node[a:b], radius)
                src.append(i + a)
                dst.append(j + a)
            a, b = new[~long], end[~long]
            n = b - a
            at, stop = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n), np.repeat(b, n)
            for k in range(1, LONG):
                on = at + k < stop
                at, stop = at[on], stop[on]
                hit = at[(node[at] != node[at + k]) & (np.bitwise_count(h[at] ^ h[at + k]) <= radius)]
                src.append(hit)
                dst.append(hit + k)
        a, b = _forest(node, np.concatenate(src), np.concatenate(dst))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    return met


def _ways(values: DataFrame, radius: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """values of scopes that hold two or more, with way; the ways, and how many values go each."""
    sizes = values.groupBy("scope").agg(F.count("*").alias("n")).where("n > 1")
    way = F.lit(WAYS.index(limits(radius)[-1][1]))
    for n, name in reversed(limits(radius)[:-1]):
        way = F.when(F.col("n") <= n, WAYS.index(name)).otherwise(way)
    own = materialize(values.join(sizes, "scope").select("scope", "h", "node", way.alias("way")), "values")
    return own, [(WAYS[r["way"]], r["count"]) for r in own.groupBy("way").count().collect()]  # a row a way


def _met(mine: DataFrame, name: str, radius: int, n: int, met, schema: str) -> DataFrame:
    if name != "all":
        return _read_where_it_lies(mine, parts(name, radius), n, met, schema)

    def grouped(key: tuple[pa.Scalar, ...], chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.frombuffer(b"".join(c.column(x).to_pylist()), U64) for x in ("scopes", "found", "nodes")] for c in chunks]
        yield from met(0, *(np.concatenate(x) for x in zip(*held, strict=True)), None)

    return _dealt(mine, math.ceil(n / CAP_ALL)).groupBy("bucket").applyInArrow(grouped, schema)


def _checked(radius: int) -> None:
    if not 0 <= radius <= 12:
        raise ValueError("radius must be 0 to 12; the masks of wider ones are too many")


def _pairs(values: DataFrame, radius: int, rows_of: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    _checked(radius)
    spark, out, names = values.sparkSession, None, [c.split()[0] for c in schema.split(", ")]
    if radius:
        own, ways = _ways(values, radius)
        for name, n in ways:
            got = _met(own.where(F.col("way") == WAYS.index(name)), name, radius, n, _meeting(parts(name, radius), radius, rows_of, names), schema)
            out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], schema) if out is None else out


def near_values(values: DataFrame, radius: int) -> DataFrame:
    """values: scope long, h long, distinct, neither null. scope, a, b: the pairs of a scope that differ in radius bits at
    most, a below b as unsigned numbers."""
    rows_of = lambda s, a, b, x, y: [z.view(np.int64) for z in (s, np.minimum(a, b), np.maximum(a, b))]
    return _pairs(values.select("scope", "h", F.col("h").alias("node")), radius, rows_of, "scope long, a long, b long")


def near_pairs(values: DataFrame, radius: int) -> DataFrame:
    """values: scope long, h long, distinct, and node long. a < b, bits: the nodes of the pairs of near_values."""

    def rows_of(s, a, b, x, y):
        x, y = x.view(np.int64), y.view(np.int64)
        return [np.minimum(x, y), np.maximum(x, y), np.bitwise_count(a ^ b).astype(np.int32)]

    return _pairs(values, radius, rows_of, "a long, b long, bits int")


def near_links(values: DataFrame, radius: int) -> DataFrame:
    """values: scope long, h long, node long; values of a scope may be equal. src, dst: links of nodes whose components are those
    of all pairs in a scope that differ in radius bits at most, fewer than there are values."""
    _checked(radius)
    schema, out = "src long, dst long", []
    own, ways = _ways(values, radius)
    for name, n in ways:
        mine, listed = own.where(F.col("way") == WAYS.index(name)).drop("way"), parts(name, radius)
        if name != "all":
            near = components(_met(mine, "windows", radius, n, _joining(parts("windows", radius), radius, whole=True), schema))
            label = near.where("node <> component").select("node", F.col("component").alias("label"))
            out.append(label.select(F.col("label").alias("src"), F.col("node").alias("dst")))
            mine = mine.join(label, "node", "left").select("scope", "h", F.coalesce("label", "node").alias("node"))
        out.append(_met(mine, name, radius, n, _joining(listed, radius), schema).distinct())
    return reduce(DataFrame.unionByName, out) if out else values.sparkSession.createDataFrame([], schema)


def hash_value(text: str | Column) -> Column:
    """A hexadecimal hash of at most 16 digits as a 64-bit number."""
    h = F.lpad(F.lower(F.col(text) if isinstance(text, str) else text), 16, "0")
    half = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hash_text(value: str) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")
