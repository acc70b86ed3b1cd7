"""What detector outputs, held as arrays of structs, say about an image: animals, content type, eyes, primary subjects.

Boxes of detectors, text and regions are struct<x0, y0, x1, y1>; a subject is struct<kind, x, y, w, h>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.tokens import col

#: fixed values: object classes that are animals
ANIMALS = ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe")
DOC_CONF, TEXT_AREA, TEXT_BLOCKS, FEW_COLOURS = 0.70, 0.04, 4, 256
CLOSED_BLINK, CLOSED_EAR = 0.50, 0.20
TIGHT_REGION, INSIDE, LEAST_FACE, SIMILAR_FACE, CROWD = 0.25, 0.5, 0.0005, 0.55, 3


def merge_animals(animals: str | Column, objects: str | Column) -> Column:
    """animals: array<struct<species, confidence>>; objects: array<struct<kind, confidence>>. The animals, and the first
    object of each animal class that is not among them; a missing confidence is 1; null arrays are empty."""
    element = "array<struct<species:string,confidence:double>>"
    known = F.coalesce(col(animals).cast(element), F.array().cast(element))
    found = F.filter(col(objects), lambda o: o["kind"].isin(*ANIMALS))
    found = F.transform(found, lambda o: F.struct(o["kind"].alias("species"), F.coalesce(o["confidence"].cast("double"), F.lit(1.0)).alias("confidence")))
    found = F.coalesce(found.cast(element), F.array().cast(element))
    add = lambda held, o: F.when(F.exists(held, lambda a: a["species"].eqNullSafe(o["species"])), held).otherwise(F.concat(held, F.array(o)))
    return F.aggregate(found, known, add)


def _area(box: Column) -> Column:
    side = lambda a, b: F.greatest(F.lit(0.0), box[b].cast("double") - box[a].cast("double"))
    return side("x0", "x1") * side("y0", "y1")


def text_area(boxes: str | Column, width: str | Column, height: str | Column) -> Column:
    """Share of the frame under text boxes, at most 1."""
    total = F.aggregate(F.transform(col(boxes), _area), F.lit(0.0), lambda s, a: s + a)
    return F.least(F.lit(1.0), F.coalesce(total, F.lit(0.0)) / F.greatest(col(width) * col(height), F.lit(1)))


def content_type(has_camera: str | Column, doc_conf: str | Column, boxes: str | Column, colours: str | Column, width: str | Column, height: str | Column, fast: bool = False) -> Column:
    """struct<kind, conf, confident>. has_camera is null where unknown; fast takes every camera shot for a photo unread."""
    camera, seen = col(has_camera), F.coalesce(col(doc_conf).cast("double"), F.lit(0.0))
    text, n = text_area(boxes, width, height), F.coalesce(F.size(col(boxes)), F.lit(0))
    flat = col(colours) < FEW_COLOURS
    answer = lambda kind, conf: F.struct(F.lit(kind).alias("kind"), conf.cast("double").alias("conf"))
    screen = lambda base: answer("screenshot", F.least(F.lit(0.99), base + text))
    rule = F.when(camera & (seen >= DOC_CONF) & (text > 0.01), answer("document", seen))
    rule = rule.when(~camera & (flat | ((text >= TEXT_AREA) & (n >= TEXT_BLOCKS))), screen(0.80)).when(~camera, answer("photo", F.lit(0.70)))
    rule = rule.when((text >= TEXT_AREA) & flat, screen(0.70)).otherwise(answer("photo", F.lit(0.80)))
    if fast:
        rule = F.when(camera, answer("photo", F.lit(0.95))).otherwise(rule)
    return F.struct(rule["kind"].alias("kind"), rule["conf"].alias("conf"), ((rule["kind"] != "photo") & (rule["conf"] >= DOC_CONF)).alias("confident"))


def eye_report(faces: str | Column) -> Column:
    """Of array<struct<left_ear, right_ear, left_blink, right_blink, smile, frown, occluded>>: struct<faces, closed_count,
    occluded_count, any_closed, min_ear, max_blink, max_smile, max_frown>. A face is closed by its worse eye; occluded ones
    are counted among the closed."""
    each = col(faces)
    shut = F.filter(each, lambda f: (F.greatest(f["left_blink"], f["right_blink"]) >= CLOSED_BLINK) | (F.least(f["left_ear"], f["right_ear"]) < CLOSED_EAR))
    number = lambda a: F.coalesce(F.size(a), F.lit(0))
    return F.struct(
        number(each).alias("faces"),
        number(shut).alias("closed_count"),
        number(F.filter(shut, lambda f: F.coalesce(f["occluded"], F.lit(False)))).alias("occluded_count"),
        (number(shut) > 0).alias("any_closed"),
        F.array_min(F.transform(each, lambda f: F.least(f["left_ear"], f["right_ear"]))).alias("min_ear"),
        F.array_max(F.transform(each, lambda f: F.greatest(f["left_blink"], f["right_blink"]))).alias("max_blink"),
        F.array_max(F.transform(each, lambda f: f["smile"])).alias("max_smile"),
        F.array_max(F.transform(each, lambda f: f["frown"])).alias("max_frown"),
    )


SUBJECTS = "array<struct<kind:string,x:double,y:double,w:double,h:double>>"


def primary_subjects(subjects: str | Column, salient: str | Column, persons: str | Column, width: str | Column, height: str | Column) -> Column:
    """The subjects that count, widest area first; none for a crowd or for specks.

    salient: one box or null; persons: array of boxes, of which the largest counts (the first on ties). Null arrays are empty.
    """
    frame = F.greatest(col(width).cast("double") * col(height).cast("double"), F.lit(1.0))
    box = lambda b, kind: F.struct(F.lit(kind).alias("kind"), b["x0"].cast("double").alias("x"), b["y0"].cast("double").alias("y"), (b["x1"] - b["x0"]).cast("double").alias("w"), (b["y1"] - b["y0"]).cast("double").alias("h"))
    none = F.array().cast(SUBJECTS)
    area = lambda s: s["w"] * s["h"]
    by_area = lambda a: F.array_sort(a, lambda p, q: F.signum(area(q) - area(p)).cast("int"))
    largest = F.get(by_area(F.transform(F.filter(col(persons), lambda b: b.isNotNull()), lambda b: box(b, "person"))), F.lit(0))
    region = F.when(col(salient).isNotNull(), box(col(salient), "saliency"))
    tight = _area(col(salient)) <= TIGHT_REGION * frame
    listed = lambda c, on=None: F.coalesce(F.when(c.isNotNull() & (on if on is not None else F.lit(True)), F.array(c)).cast(SUBJECTS), none)
    front = F.concat(listed(region, tight), listed(largest))
    anything = by_area(F.concat(front, listed(region, ~tight)))
    every = F.coalesce(col(subjects).cast(SUBJECTS), none)
    faces = by_area(F.filter(every, lambda s: s["kind"] == "face"))
    overlap = lambda a, b, at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    within = lambda f, r: overlap(f, r, "x", "w") * overlap(f, r, "y", "h") > INSIDE * F.greatest(area(f), F.lit(1.0))
    inside = F.filter(faces, lambda f: F.exists(front, lambda r: within(f, r)))
    top = area(F.get(faces, F.lit(0)))
    peers = F.filter(faces, lambda f: area(f) >= SIMILAR_FACE * top)
    faceless = F.when(F.size(anything) > 0, F.slice(anything, 1, 1)).otherwise(F.slice(every, 1, 1))
    return F.when(F.size(faces) == 0, faceless).when(F.size(inside) > 0, inside).when((top < LEAST_FACE * frame) | (F.size(peers) >= CROWD), none).otherwise(peers)
