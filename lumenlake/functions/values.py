"""Hashes, colours, vectors and capture values as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlake.functions.tokens import col


def hamming(a: str | Column, b: str | Column) -> Column:
    """Bits that differ between two hexadecimal hashes of at most 16 digits, by 32-bit halves."""
    x, y = F.lpad(col(a), 16, "0"), F.lpad(col(b), 16, "0")
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.bit_count(half(x, 1).bitwiseXOR(half(y, 1))) + F.bit_count(half(x, 9).bitwiseXOR(half(y, 9)))


def cosine(a: str | Column, b: str | Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x, y = col(a), col(b)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def hsl(r: str | Column, g: str | Column, b: str | Column) -> Column:
    """struct<h (degrees), s, l> of 0..255 channels."""
    r, g, b = (col(c) / 255.0 for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    sat = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - top - low)).otherwise(d / (top + low))
    sixth = F.when(top == r, F.pmod((g - b) / d, F.lit(6.0))).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.struct(F.when(d == 0, 0.0).otherwise(sixth * 60).alias("h"), sat.alias("s"), light.alias("l"))


def hue_distance(a: str | Column, b: str | Column) -> Column:
    d = F.pmod(F.abs(col(a) - col(b)), F.lit(360.0))
    return F.least(d, 360 - d)


def thirds_offset(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Of a box's centre to the nearest of the four thirds points, as a share of half the diagonal."""
    cx, cy = x + w / 2, y + h / 2
    return F.least(*[F.hypot(cx - width * i / 3, cy - height * j / 3) for i in (1, 2) for j in (1, 2)]) / (0.5 * F.hypot(width, height))


def sharpness_score(lap: str | Column, ten: str | Column, long_edge: str | Column) -> Column:
    s = F.pow(2000.0 / col(long_edge), F.lit(2.0))
    return 0.5 * col(lap) / (col(lap) + 150 * s) + 0.5 * col(ten) / (col(ten) + 600 * s)


def exif_time(text: str | Column) -> Column:
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy:MM:dd")
    return F.coalesce(*[F.try_to_timestamp(F.trim(col(text)), F.lit(f)) for f in forms]).cast("timestamp_ntz")


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed decimal degrees; south and west are negative."""
    d = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -d).otherwise(d)


def face_quality(det: Column, box_w: Column, box_h: Column, width: Column, height: Column, lap: Column, pitch: Column, yaw: Column) -> Column:
    area = F.least(F.lit(1.0), box_w * box_h / (0.05 * width * height))
    sharp = F.when(F.least(box_w, box_h) < 8, 0.0).otherwise(F.least(F.lit(1.0), lap / 500.0))
    pose = F.coalesce(F.greatest(F.lit(0.0), 1 - F.greatest(F.abs(pitch), F.abs(yaw)) / 45.0), F.lit(1.0))
    return 0.3 * det + 0.2 * area + 0.3 * sharp + 0.2 * pose


def focus_on_background(near: str | Column, far: str | Column) -> Column:
    return (col(near) < 200) & (col(far) > 1.3 * col(near))


def colour_class(r: str | Column, g: str | Column, b: str | Column, sat: str | Column) -> Column:
    """struct<cast_strength, cast_hue, temperature, saturation> of mean channels and mean saturation."""
    r, g, b, s = col(r), col(g), col(b), col(sat)
    grey = (r + g + b) / 3.0
    off = [(x - grey) / F.greatest(grey, F.lit(1e-6)) for x in (r, g, b)]
    most = F.greatest(*[F.abs(x) for x in off])
    named = F.when(F.abs(off[0]) == most, "red").when(F.abs(off[1]) == most, "green").otherwise("blue")
    warm = (r - b) / F.greatest(grey, F.lit(1e-6))
    return F.struct(
        most.alias("cast_strength"),
        F.when(most > 0.18, named).alias("cast_hue"),
        F.when(warm > 0.08, "warm").when(warm < -0.08, "cool").otherwise("neutral").alias("temperature"),
        F.when(s < 0.10, "mono").when(s > 0.45, "vivid").otherwise("muted").alias("saturation"),
    )
