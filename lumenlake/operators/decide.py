"""Keeper, review or reject, with stars, reasons and warnings, from flat metric columns; Columns only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: fixed values: limits and weights of decisions; the texts of reasons and warnings below are fixed as well
@dataclass(frozen=True)
class Thresholds:
    sharp_keeper: float = 0.55
    sharp_reject: float = 0.30
    accept_overexposed: bool = False
    accept_underexposed: bool = False
    reject_closed_eyes: bool = True
    closed_eyes_min_ratio: float = 0.5
    ear_closed: float = 0.20
    ear_open: float = 0.35
    discount_occluded_eyes: bool = True
    horizon_warn_deg: float = 3.0
    accept_focus_on_background: bool = False
    soft_face_lap_max: float = 50.0
    soft_face_ref: float = 0.35
    motion_blur_anisotropy: float = 0.45
    cast_warn: float = 0.25
    w_sharpness: float = 0.50
    w_exposure: float = 0.18
    w_eyes: float = 0.14
    w_composition: float = 0.08
    w_aesthetic: float = 0.10


def _clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def exposure_flags(df: DataFrame) -> DataFrame:
    """underexposed and overexposed from mean luma and clipped shares, where df does not say so itself."""
    dark = (F.col("mean_luma") < 50) & (F.col("clipped_shadow") > 0.20)
    bright = (F.col("mean_luma") > 210) | (F.col("clipped_highlight") > 0.15)
    known = lambda name, c: F.coalesce(F.col(name), c) if name in df.columns else c
    return df.withColumns({"underexposed": known("underexposed", dark), "overexposed": known("overexposed", bright)})


def exposure_score() -> Column:
    mean, span = F.coalesce("mean_luma", F.lit(128.0)), F.coalesce("dynamic_range", F.lit(0.0))
    return F.when(F.coalesce("overexposed", F.lit(False)) | F.coalesce("underexposed", F.lit(False)), 0.2).otherwise(0.6 * (1 - F.abs(mean - 128) / 128) + 0.4 * F.least(F.lit(1.0), span / 200))


def eyes_score(t: Thresholds = Thresholds()) -> Column:
    blinks = F.col("closed_count").isNull() | (F.col("closed_count") - F.coalesce("occluded_count", F.lit(0)) > 0)
    open_ = _clamp((F.col("min_ear") - t.ear_closed) / max(t.ear_open - t.ear_closed, 1e-6))
    return F.when(F.coalesce("faces", F.lit(0)) == 0, None).when(F.coalesce("any_closed", F.lit(False)) & blinks, 0.0).when(F.col("min_ear").isNotNull(), open_)


def composition_score() -> Column:
    tilt, thirds = F.greatest(F.lit(0.0), 1 - F.abs("horizon_tilt_deg") / 10), F.greatest(F.lit(0.0), 1 - F.col("thirds_offset"))
    tilt, thirds = F.when(F.col("horizon_tilt_deg").isNotNull(), tilt), F.when(F.col("thirds_offset").isNotNull(), thirds)
    return F.when(tilt.isNotNull() & thirds.isNotNull(), (tilt + thirds) / 2).otherwise(F.coalesce(tilt, thirds))


def aesthetic_term() -> Column:
    return F.when((F.col("aesthetic_source") == "topiq") & F.col("aesthetic_score").isNotNull(), _clamp((F.col("aesthetic_score") - 0.35) / 0.40)).otherwise(F.col("aesthetic_score"))


def used_sharpness() -> Column:
    return F.coalesce("subject_sharp_score", "sharp_score", F.lit(0.0))


def quality_score(t: Thresholds = Thresholds()) -> Column:
    """Weighted mean of the terms that are present."""
    terms = [(t.w_sharpness, used_sharpness()), (t.w_exposure, exposure_score()), (t.w_eyes, eyes_score(t)), (t.w_composition, composition_score()), (t.w_aesthetic, aesthetic_term())]
    top, total = F.lit(0.0), F.lit(0.0)
    for w, v in terms:
        top, total = top + F.coalesce(w * v, F.lit(0.0)), total + F.when(v.isNotNull(), w).otherwise(0.0)
    return top / total


def soft_face_threshold(t: Thresholds = Thresholds()) -> Column:
    """For the widest face, by its long edge against the decoded frame's; the base value without one."""
    scale = _clamp(F.greatest("face_w", "face_h") / F.col("decoded_long") / t.soft_face_ref, 0.4, 1.5)
    return F.when(F.col("face_w").isNotNull() & F.col("decoded_long").isNotNull(), t.soft_face_lap_max * scale).otherwise(t.soft_face_lap_max)


def decide(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """image_id, verdict, stars, label, reasons, warnings, score. face_subject, where there is such a column, says whether a face
    is among the subjects; else the number of faces does."""
    df = exposure_flags(metrics).withColumn("score", quality_score(t)).withColumn("sharp", used_sharpness())
    has_face = F.coalesce("face_subject", F.lit(False)) if "face_subject" in metrics.columns else F.coalesce("faces", F.lit(0)) > 0
    soft = has_face & F.col("subject_sharp_score").isNotNull() & (F.coalesce("laplacian_var", F.lit(0.0)) < soft_face_threshold(t))
    blur = F.when(F.coalesce("fft_anisotropy", F.lit(0.0)) > t.motion_blur_anisotropy, F.when(F.col("blur_angle_deg").isNotNull(), F.concat(F.lit("motion blur (~"), F.rint("blur_angle_deg").cast("int").cast("string"), F.lit("°)"))).otherwise("motion blur")).otherwise("out of focus")
    blurred = (F.col("sharp") < t.sharp_reject) | (soft & (F.col("sharp") < t.sharp_keeper))
    behind = F.coalesce("focus_on_background", F.lit(False)) & F.lit(not t.accept_focus_on_background)
    soft_frame = F.col("sharp") < t.sharp_keeper
    first = F.when(blurred, blur).when(behind, "subject out of focus (background sharp)").when(soft_frame, "slightly soft")
    verdict = F.when(blurred | behind, "reject").when(soft_frame, "review").otherwise("keeper")

    n = F.coalesce("faces", F.lit(0))
    hidden = F.coalesce("occluded_count", F.lit(0)) if t.discount_occluded_eyes else F.lit(0)
    closed = F.greatest(F.lit(0), F.col("closed_count") - hidden)
    blink = F.coalesce("any_closed", F.lit(False)) & F.lit(t.reject_closed_eyes)
    share = F.when(n > 0, closed / n).otherwise(1.0)
    eyes = blink & (F.col("closed_count").isNull() | ((closed > 0) & ((n <= 1) | (share >= t.closed_eyes_min_ratio))))
    shown = F.coalesce(closed.cast("string"), F.lit("None"))
    eyes_reason = F.when(eyes, F.when(n <= 1, "eyes closed").otherwise(F.concat(F.lit("eyes closed ("), F.when(F.col("closed_count").isNull(), "None").otherwise(shown), F.lit("/"), n.cast("string"), F.lit(")"))))
    verdict = F.when(eyes, "reject").otherwise(verdict)
    over, under = F.col("overexposed") & F.lit(not t.accept_overexposed), F.col("underexposed") & F.lit(not t.accept_underexposed)
    verdict = F.when((verdict == "keeper") & (F.coalesce(over, F.lit(False)) | F.coalesce(under, F.lit(False))), "review").otherwise(verdict)
    listed = lambda *c: F.array_compact(F.array(*c))
    tilt = F.bround("horizon_tilt_deg", 1)
    df = df.withColumn("verdict", verdict)
    stars = F.when(F.col("score") >= 0.80, 5).when(F.col("score") >= 0.65, 4).when(F.col("score") >= 0.50, 3).when(F.col("score") >= 0.35, 2).otherwise(1)
    return df.select(
        "image_id",
        "verdict",
        F.when(F.col("verdict") == "reject", 0).when(F.col("verdict") == "keeper", F.greatest(stars, F.lit(3))).otherwise(F.greatest(F.lit(2), F.least(stars, F.lit(4)))).alias("stars"),
        F.when(F.col("verdict") == "keeper", "green").when(F.col("verdict") == "review", "yellow").otherwise("red").alias("label"),
        listed(first, eyes_reason, F.when(over, "overexposed / clipped highlights"), F.when(under, "underexposed")).alias("reasons"),
        listed(
            F.when(blink & F.col("closed_count").isNotNull() & (closed > 0) & ~eyes, F.concat(closed.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" subjects blinking"))),
            F.when(F.abs("horizon_tilt_deg") > t.horizon_warn_deg, F.concat(F.lit("horizon tilt "), F.format_string("%+.1f", tilt), F.lit("°"))),
            F.when(F.col("cast_strength") > t.cast_warn, F.concat("cast_hue", F.lit(" colour cast"))),
        ).alias("warnings"),
        "score",
    )


def burst_score() -> Column:
    """Weights sum to 1.10 and are not normalised; a frame without faces has open eyes and no smile."""
    none = F.coalesce("faces", F.lit(0)) == 0
    eye = F.when(none, 1.0).when(F.coalesce("any_closed", F.lit(False)), 0.0).otherwise(1 - F.coalesce("max_blink", F.lit(0.0)))
    smile = F.when(none, 0.0).otherwise(F.coalesce("max_smile", F.lit(0.0)))
    fine = F.when(F.coalesce("overexposed", F.lit(False)) | F.coalesce("underexposed", F.lit(False)), 0.0).otherwise(1.0)
    clip = F.least(F.lit(1.0), F.coalesce("clipped_highlight", F.lit(0.0)) + F.coalesce("clipped_shadow", F.lit(0.0)))
    beauty = F.when(F.coalesce("aesthetic_score", F.lit(0.0)) == 0, 0.5).otherwise(F.col("aesthetic_score"))
    return 0.45 * used_sharpness() + 0.20 * eye + 0.10 * smile + 0.12 * fine + 0.10 * (1 - clip) + 0.13 * beauty


def reclassify(metrics: DataFrame, verdicts: DataFrame, t: Thresholds) -> DataFrame:
    """verdicts (with user_override) decided again, but for overridden rows."""
    new = decide(metrics, t)
    names = [c for c in new.columns if c != "image_id"]
    old = verdicts.select("image_id", "user_override", *[F.col(c).alias(f"old_{c}") for c in names])
    kept = F.coalesce("user_override", F.lit(False))
    return old.join(new, "image_id", "left").select("image_id", *[F.when(kept | F.col("verdict").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c) for c in names], "user_override")
