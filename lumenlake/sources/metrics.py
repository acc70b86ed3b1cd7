"""Measures as they are stored, one nested value an image, and the flat columns that decisions, filters and groups read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.functions.detections import CLOSED_BLINK, CLOSED_EAR

_SHARPNESS = "struct<laplacian_var:double,tenengrad:double,fft_anisotropy:double,score:double,blur_angle_deg:double>"
#: fixed values: the fields of a stored measure
NESTED = ", ".join(
    f"{name} {kind}"
    for name, kind in {
        "sharpness": _SHARPNESS,
        "subject_sharpness": _SHARPNESS,
        "subjects": "array<struct<bbox:array<int>,kind:string,confidence:double,is_primary:boolean>>",
        "exposure": "struct<mean_luma:double,clipped_highlight:double,clipped_shadow:double,dynamic_range:double,underexposed:boolean,overexposed:boolean>",
        "eyes": "struct<faces:int,ears:array<double>,blinks:array<array<double>>,min_ear:double,max_blink:double,any_closed:boolean,closed_count:int,smiles:array<double>,frowns:array<double>,brows_down:array<double>,max_smile:double,max_frown:double,max_brow_down:double,occluded:array<boolean>,occluded_count:int>",
        "noise_sigma": "double",
        "aesthetic_score": "double",
        "aesthetic_source": "string",
        "composition": "struct<horizon_tilt_deg:double,thirds_offset:double,horizon_source:string>",
        "color": "struct<dominant:array<array<int>>,temperature:string,saturation:string,cast_strength:double,cast_hue:string>",
        "hashes": "struct<phash:string,dhash:string>",
        "source_size": "array<int>",
        "decoded_size": "array<int>",
        "kind": "string",
        "scene": "struct<top:array<struct<label:string,prob:double>>,primary:string>",
        "objects": "struct<detections:array<struct<class:string,conf:double,bbox:array<int>>>,primary:string>",
        "subject_seg": "struct<coverage:double,bbox:array<int>>",
        "depth": "struct<near_sharpness:double,far_sharpness:double,focus_on_background:boolean,depth_range:double,near_far_ratio:double>",
        "content_type": "struct<class:string,conf:double,source:string,has_camera:boolean,text_area:double,colors:int>",
        "ocr": "array<struct<text:string,confidence:double,bbox:array<int>>>",
        "animals": "array<struct<species:string,confidence:double,bbox:array<int>>>",
        "live_photo": "struct<video:string>",
    }.items()
)


def parsed(df: DataFrame, column: str = "metrics_json") -> DataFrame:
    """df with its measures as the fields of NESTED; faulty text gives nulls."""
    kept = [c for c in df.columns if c != column]
    return df.select(*kept, F.from_json(column, NESTED).alias("_m")).select(*kept, "_m.*")


def _present(s: str, *fields: str) -> Column:
    """Whether a struct says anything: an empty one counts as missing."""
    return F.coalesce(*[F.col(f"{s}.{f}").isNotNull() for f in fields]) if len(fields) == 1 else F.greatest(*[F.col(f"{s}.{f}").isNotNull() for f in fields])


def chosen_face() -> Column:
    """struct<w, h> of the face subject that is widest, the higher of equals; null without one."""
    faces = F.filter("subjects", lambda s: (s["kind"] == "face") & (F.size(s["bbox"]) >= 4))
    return F.array_max(F.transform(faces, lambda s: F.struct(s["bbox"][2].alias("w"), s["bbox"][3].alias("h"))))


def flat(df: DataFrame) -> DataFrame:
    """image_id and the columns that decide() and the catalogue's filters read, from the fields of NESTED.

    The subject's sharpness stands for the frame's wherever there is one. Eyes keep what is stored; where a measure has the
    faces' ears and blinks but no counts, these are taken from them: a face is closed by its worse eye."""
    held = ("laplacian_var", "tenengrad", "fft_anisotropy", "score", "blur_angle_deg")
    subject = F.coalesce(_present("subject_sharpness", *held), F.lit(False))
    used = lambda f: F.when(subject, F.col(f"subject_sharpness.{f}")).otherwise(F.col(f"sharpness.{f}")).alias(f)
    worst = F.arrays_zip(F.col("eyes.ears").alias("ear"), F.col("eyes.blinks").alias("blink"))
    shut = F.size(F.filter(worst, lambda f: F.coalesce(f["ear"] < CLOSED_EAR, F.lit(False)) | F.coalesce(F.array_max(f["blink"]) >= CLOSED_BLINK, F.lit(False))))
    counted = F.col("eyes.any_closed").isNull() & F.col("eyes.ears").isNotNull() & F.col("eyes.blinks").isNotNull()
    face, sides = chosen_face(), F.col("decoded_size")
    first = lambda i: F.get(F.get("color.dominant", F.lit(0)), F.lit(i))
    return df.select(
        "image_id",
        F.col("sharpness.score").alias("sharp_score"),
        F.when(subject, F.coalesce("subject_sharpness.score", F.lit(0.0))).alias("subject_sharp_score"),
        *[used(f) for f in ("laplacian_var", "tenengrad", "fft_anisotropy", "blur_angle_deg")],
        *[F.col(f"exposure.{f}").alias(f) for f in ("mean_luma", "dynamic_range", "clipped_highlight", "clipped_shadow", "underexposed", "overexposed")],
        F.coalesce("eyes.faces", F.lit(0)).alias("faces"),
        F.coalesce(F.exists("subjects", lambda s: s["kind"] == "face"), F.lit(False)).alias("face_subject"),
        F.when(counted, shut).otherwise(F.col("eyes.closed_count")).alias("closed_count"),
        F.when(counted, shut > 0).otherwise(F.col("eyes.any_closed")).alias("any_closed"),
        F.coalesce("eyes.occluded_count", F.size(F.filter("eyes.occluded", lambda o: o)), F.lit(0)).alias("occluded_count"),
        F.coalesce("eyes.min_ear", F.array_min("eyes.ears")).alias("min_ear"),
        F.coalesce("eyes.max_blink", F.array_max(F.transform("eyes.blinks", F.array_max))).alias("max_blink"),
        F.coalesce("eyes.max_smile", F.array_max("eyes.smiles")).alias("max_smile"),
        "composition.horizon_tilt_deg",
        "composition.thirds_offset",
        "aesthetic_score",
        "aesthetic_source",
        "noise_sigma",
        face["w"].alias("face_w"),
        face["h"].alias("face_h"),
        F.when(F.size(sides) == 2, F.when(F.array_max(sides) == 0, 1).otherwise(F.array_max(sides))).alias("decoded_long"),
        F.coalesce("depth.focus_on_background", F.lit(False)).alias("focus_on_background"),
        *[F.col(f"color.{f}").alias(f) for f in ("cast_strength", "cast_hue", "temperature", "saturation")],
        first(0).alias("dom_r"),
        first(1).alias("dom_g"),
        first(2).alias("dom_b"),
        F.col("scene.primary").alias("scene"),
        F.col("content_type.class").alias("content_type"),
        F.transform("ocr", lambda b: b["text"]).alias("ocr_texts"),
        F.transform("animals", lambda a: a["species"]).alias("animals"),
    )
