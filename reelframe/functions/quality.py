"""Frame quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.common import clip, col, is_finite

# Metric fields of a raw quality record and their weights.
QUALITY_WEIGHTS = {
    "laplacian_var": 0.40,
    "tenengrad": 0.30,
    "exposure": 0.15,
    "orb_keypoints": 0.15,
}
# Default thresholds of the quality gates.
QUALITY_THRESHOLD = 0.50
ABS_LAPLACIAN_MIN = 35.0
LAPLACIAN_THRESHOLD = 100.0
MOTION_BLUR_THRESHOLD = 0.3
EXPOSURE_THRESHOLD = 0.35
# Outcome names.
PASS, GUARD, BELOW, LEGACY = "pass", "abs_laplacian_guard", "quality_below_threshold", "legacy_threshold"


def normalized(value: str | Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1] between two bounds; 0.5 on a flat span, 0 if not finite."""
    v = F.coalesce(col(value), F.lit(0.0))
    span = high - low
    return (
        F.when(~is_finite(v), F.lit(0.0))
        .when(span <= 1e-12, F.lit(0.5))
        .otherwise(clip((v - low) / span, 0.0, 1.0))
    )


def compose_quality(metrics: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the normalised metrics, missing ones counting as 0."""
    w = {**QUALITY_WEIGHTS, **(weights or {})}
    if sum(w.values()) <= 1e-12:
        w = QUALITY_WEIGHTS
    score = F.lit(0.0)
    for field, weight in w.items():
        score = score + F.lit(float(weight)) * F.coalesce(metrics.get(field, F.lit(0.0)), F.lit(0.0))
    return clip(score / F.lit(float(sum(w.values()))), 0.0, 1.0)


def abs_guard(laplacian_var: str | Column, minimum: float = ABS_LAPLACIAN_MIN) -> Column:
    return F.coalesce(col(laplacian_var), F.lit(0.0)) >= F.lit(float(minimum))


def drop_reason(guard_ok: Column, quality: Column, threshold: float = QUALITY_THRESHOLD) -> Column:
    """A failed guard wins over a failed threshold."""
    return F.when(~guard_ok, GUARD).when(quality < F.lit(float(threshold)), BELOW).otherwise(PASS)


def legacy_proxy(
    sharpness: str | Column,
    exposure: str | Column,
    motion_blur: str | Column,
    laplacian_threshold: float = LAPLACIAN_THRESHOLD,
    blur_threshold: float = MOTION_BLUR_THRESHOLD,
    exposure_threshold: float = EXPOSURE_THRESHOLD,
) -> Column:
    """Mean of three ratios to their thresholds, each clipped to [0, 1]."""
    sharp = clip(F.coalesce(col(sharpness), F.lit(0.0)) / max(laplacian_threshold, 1e-6), 0.0, 1.0)
    light = clip(F.coalesce(col(exposure), F.lit(0.0)) / max(exposure_threshold, 1e-6), 0.0, 1.0)
    still = clip(1.0 - F.coalesce(col(motion_blur), F.lit(1.0)) / max(blur_threshold, 1e-6), 0.0, 1.0)
    return clip((sharp + light + still) / 3.0, 0.0, 1.0)


def legacy_gate(
    sharpness: str | Column,
    exposure: str | Column,
    motion_blur: str | Column,
    laplacian_threshold: float = LAPLACIAN_THRESHOLD,
    blur_threshold: float = MOTION_BLUR_THRESHOLD,
    exposure_threshold: float = EXPOSURE_THRESHOLD,
) -> Column:
    return (
        (F.coalesce(col(sharpness), F.lit(0.0)) >= laplacian_threshold)
        & (F.coalesce(col(motion_blur), F.lit(1.0)) <= blur_threshold)
        & (F.coalesce(col(exposure), F.lit(0.0)) >= exposure_threshold)
    )


def gray_exposure(mean_brightness: str | Column) -> Column:
    """Gaussian of the mean brightness around 128 with sigma 80."""
    d = col(mean_brightness) - 128.0
    return F.exp(-(d * d) / (2.0 * 80.0 * 80.0))


def roi_mode(spec: str | Column) -> Column:
    """Shape part of a region spec such as ``rect:0.6``; ``circle`` by default."""
    mode = F.trim(F.split(F.lower(F.trim(col(spec))), ":", 2)[0])
    return F.when(mode.isin("circle", "rect"), mode).otherwise("circle")


def roi_ratio(spec: str | Column) -> Column:
    """Ratio part of a region spec, 0.40 if absent or unreadable, within [0.05, 1]."""
    parts = F.split(F.lower(F.trim(col(spec))), ":", 2)
    return clip(F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(0.40)), 0.05, 1.0)
