"""Path-safe folder tokens and metadata buckets as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: file name extensions by kind
RAW = ("cr2", "cr3", "nef", "nrw", "arw", "srf", "sr2", "raf", "rw2", "orf", "pef", "dng", "rwl", "3fr", "iiq")
JPEG, HEIC, OTHER = ("jpg", "jpeg", "jpe"), ("heic", "heif"), ("png", "tif", "tiff", "webp", "bmp")
UNKNOWN, UNDATED = "_unknown", "_undated"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def file_kind(path: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(col(path), r"[^/]\.([^./]+)$", 1))
    return F.when(ext.isin(*RAW), "raw").when(ext.isin(*JPEG), "jpeg").when(ext.isin(*HEIC), "heic").when(ext.isin(*OTHER), "other").otherwise("unknown")


def safe(c: str | Column) -> Column:
    """Letters, digits, - _ . stay; all else is an underscore; empty or null is unknown."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(col(c)), r"[^\p{L}\p{N}\-_.]", "_"), F.lit("")), F.lit(UNKNOWN))


def date_token(seconds: str | Column, form: str) -> Column:
    """form: a Spark date pattern; slashes part folders."""
    return F.coalesce(F.date_format(F.timestamp_seconds(col(seconds)), form), F.lit(UNDATED))


def join_safe(*parts: str | Column) -> Column:
    return safe(F.concat_ws(" ", *[F.nullif(F.trim(col(p)), F.lit("")) for p in parts]))


def focal_bucket(mm: str | Column) -> Column:
    f = col(mm)
    return F.when(f.isNull(), UNKNOWN).when(f < 16, "ultrawide").when(f < 35, "wide").when(f < 70, "standard").when(f < 135, "short-tele").when(f < 300, "tele").otherwise("super-tele")


def orientation(width: str | Column, height: str | Column, missing: str = UNKNOWN) -> Column:
    w, h = col(width), col(height)
    return F.when(F.coalesce(w, F.lit(0)) * F.coalesce(h, F.lit(0)) == 0, missing).when(F.abs(w - h) <= 0.02 * F.greatest(w, h), "square").when(w > h, "landscape").otherwise("portrait")


def iso_bucket(iso: str | Column, missing: str = UNKNOWN, prefix: str = "iso-") -> Column:
    i = col(iso)
    named = F.when(i <= 200, "low").when(i <= 1600, "mid").when(i <= 6400, "high").otherwise("extreme")
    return F.when(F.coalesce(i, F.lit(0)) == 0, missing).otherwise(F.concat(F.lit(prefix), named))


def aperture_bucket(f_number: str | Column) -> Column:
    f = col(f_number)
    return F.when(F.coalesce(f, F.lit(0.0)) == 0, "mid").when(f < 2.8, "wide").when(f <= 5.6, "mid").otherwise("narrow")


def star_token(stars: str | Column) -> Column:
    return F.when(F.coalesce(col(stars), F.lit(0)) == 0, UNKNOWN).otherwise(F.concat(col(stars).cast("string"), F.lit("-star")))


def hemisphere(lat: str | Column, lon: str | Column) -> Column:
    name = F.concat(F.lit("hemisphere-"), F.when(col(lat) >= 0, "N").otherwise("S"), F.when(col(lon) >= 0, "E").otherwise("W"))
    return safe(F.when(col(lat).isNotNull() & col(lon).isNotNull(), name))


def exposure_text(seconds: str | Column) -> Column:
    t = col(seconds)
    whole = F.when(t == F.floor(t), F.floor(t).cast("string")).otherwise(t.cast("string"))
    return F.when(t >= 1, F.concat(whole, F.lit("s"))).when(t > 0, F.concat(F.lit("1/"), F.rint(1 / t).cast("long").cast("string")))


#: name -> Column over image rows joined with verdict and metric columns
TOKENS: dict[str, Callable[[], Column]] = {
    "date:YYYY": lambda: date_token("capture_s", "yyyy"),
    "date:YYYY-MM": lambda: date_token("capture_s", "yyyy-MM"),
    "date:YYYY-MM-DD": lambda: date_token("capture_s", "yyyy-MM-dd"),
    "date:YYYY/MM": lambda: date_token("capture_s", "yyyy/MM"),
    "date:YYYY/MM/DD": lambda: date_token("capture_s", "yyyy/MM/dd"),
    "camera:make": lambda: safe("camera_make"),
    "camera:model": lambda: safe("camera_model"),
    "camera:make_model": lambda: join_safe("camera_make", "camera_model"),
    "lens:model": lambda: safe("lens_model"),
    "focal_bucket": lambda: focal_bucket("focal_length_mm"),
    "orientation": lambda: orientation("width", "height"),
    "iso_bucket": lambda: iso_bucket("iso"),
    "flash": lambda: F.coalesce(F.when(F.col("flash_fired"), "flash").when(~F.col("flash_fired"), "no-flash"), F.lit(UNKNOWN)),
    "quality:verdict": lambda: F.coalesce("verdict", F.lit(UNKNOWN)),
    "quality:stars": lambda: star_token("stars"),
    "gps:country": lambda: hemisphere("gps_lat", "gps_lon"),
    "gps:city": lambda: safe("city"),
    "event": lambda: safe("event_label"),
    "scene": lambda: safe("scene"),
    "object:class": lambda: safe("object_class"),
    "content_type": lambda: safe("content_type"),
    "palette:temperature": lambda: safe("temperature"),
    "palette:saturation": lambda: safe("saturation"),
}


def register_token(name: str, build: Callable[[], Column]) -> None:
    TOKENS[name] = build


def list_tokens() -> list[str]:
    return list(TOKENS)


def token(name: str) -> Column:
    if name not in TOKENS:
        raise ValueError(f"unknown token: {name}")
    return TOKENS[name]()
