"""Per-video normalisation, quality gates and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import quality as Q
from reelframe.functions.common import col
from reelframe.plans.blocks import attach
from reelframe.plans.percentiles import exact_percentiles

FIELDS = tuple(Q.QUALITY_WEIGHTS)


def percentile_bounds(
    df: DataFrame, keys: Sequence[str], fields: Sequence[str] = FIELDS, p_low: float = 10.0, p_high: float = 90.0
) -> DataFrame:
    """``<field>_low`` and ``<field>_high`` per key over its whole scan; (0, 1) without finite values."""
    p_low = min(max(p_low, 0.0), 100.0)
    p_high = min(max(p_high, p_low), 100.0)
    filled = df.select(*keys, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields])
    q = exact_percentiles(filled, keys, fields, [p_low / 100.0, p_high / 100.0])
    return q.select(
        *keys,
        *[F.coalesce(f"{f}_p0", F.lit(0.0)).alias(f"{f}_low") for f in fields],
        *[F.coalesce(f"{f}_p1", F.lit(1.0)).alias(f"{f}_high") for f in fields],
    )


def normalize(
    df: DataFrame, bounds: DataFrame, keys: Sequence[str], fields: Sequence[str] = FIELDS, spread: str = "frame_index"
) -> DataFrame:
    """Add ``norm_<field>``; each video's bounds are spread over many tasks."""
    out = attach(df, bounds, keys, F.col(spread))
    return out.withColumns(
        {f"norm_{f}": Q.normalized(f, F.col(f"{f}_low"), F.col(f"{f}_high")) for f in fields}
    ).drop(*[f"{f}_{side}" for f in fields for side in ("low", "high")])


def quality_gate(
    df: DataFrame,
    keys: Sequence[str] = ("video_id",),
    *,
    bounds: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    threshold: float = Q.QUALITY_THRESHOLD,
    abs_min: float = Q.ABS_LAPLACIAN_MIN,
    p_low: float = 10.0,
    p_high: float = 90.0,
) -> DataFrame:
    """Normalise, compose and gate every frame: ``quality``, ``is_pass``, ``drop_reason``.

    Given ``bounds`` (for example frozen from an earlier run) are used as they are.
    """
    if bounds is None:
        bounds = percentile_bounds(df, keys, p_low=p_low, p_high=p_high)
    out = normalize(df, bounds, keys)
    score = Q.compose_quality({f: F.col(f"norm_{f}") for f in FIELDS}, weights)
    out = out.withColumn("quality", score)
    reason = Q.drop_reason(Q.abs_guard("laplacian_var", abs_min), F.col("quality"), threshold)
    return out.withColumn("drop_reason", reason).withColumn("is_pass", F.col("drop_reason") == Q.PASS)


def pair_gate(
    pairs: DataFrame,
    *,
    threshold: float = Q.QUALITY_THRESHOLD,
    abs_min: float = Q.ABS_LAPLACIAN_MIN,
) -> DataFrame:
    """Gate paired lenses by their worse side; needs ``a_``/``b_`` quality, laplacian_var, exposure."""
    quality = F.least("a_quality", "b_quality")
    guard = Q.abs_guard("a_laplacian_var", abs_min) & Q.abs_guard("b_laplacian_var", abs_min)
    reason = Q.drop_reason(guard, quality, threshold)
    return (
        pairs.withColumn("quality", quality)
        .withColumn("sharpness", F.least("a_laplacian_var", "b_laplacian_var"))
        .withColumn("exposure", F.least("a_exposure", "b_exposure"))
        .withColumn("drop_reason", reason)
        .withColumn("is_pass", reason == Q.PASS)
    )


def legacy_pair_gate(pairs: DataFrame) -> DataFrame:
    """Legacy thresholds on both lenses; worse sharpness and exposure, stronger blur."""
    both = Q.legacy_gate("a_sharpness", "a_exposure", "a_motion_blur") & Q.legacy_gate(
        "b_sharpness", "b_exposure", "b_motion_blur"
    )
    quality = F.least(
        Q.legacy_proxy("a_sharpness", "a_exposure", "a_motion_blur"),
        Q.legacy_proxy("b_sharpness", "b_exposure", "b_motion_blur"),
    )
    return (
        pairs.withColumn("sharpness", F.least("a_sharpness", "b_sharpness"))
        .withColumn("exposure", F.least("a_exposure", "b_exposure"))
        .withColumn("motion_blur", F.greatest("a_motion_blur", "b_motion_blur"))
        .withColumn("quality", quality)
        .withColumn("is_pass", both)
    )


def quality_summary(records: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Totals, pass ratio, reason counts and quality range per video."""
    keys = list(keys)
    by_reason = records.groupBy(*keys, "drop_reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_pass").alias("passed"),
        F.min("quality").alias("lo"),
        F.max("quality").alias("hi"),
    )
    base = by_reason.groupBy(*keys).agg(
        F.sum("n").alias("total_records"),
        F.sum("passed").alias("passed_records"),
        F.min("lo").alias("quality_min"),
        F.max("hi").alias("quality_max"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("drop_reason", "n")))).alias("drop_reason_counts"),
    )
    medians = exact_percentiles(records, keys, ["quality"], [0.5]).select(
        *keys, F.col("quality_p0").alias("quality_median")
    )
    return (
        base.withColumn("pass_ratio", F.col("passed_records") / F.greatest("total_records", F.lit(1)))
        .join(medians, keys)
    )


def reason_counts(df: DataFrame, keys: Sequence[str], reason: str, order: str) -> DataFrame:
    """Count and first position of each reason; one small row per (key, reason)."""
    return df.groupBy(*keys, F.coalesce(F.col(reason), F.lit("unknown")).alias(reason)).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at")
    )


def vo_summary(df: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "frame_index") -> DataFrame:
    """Odometry counts, valid ratio, dominant reason and confidence percentiles per video."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("vo_attempted").alias("attempted"),
        F.count_if("vo_valid").alias("valid"),
        F.count_if("vo_pose_valid").alias("pose_valid"),
        F.count_if("has_pose").alias("trajectory_points"),
        F.coalesce(F.avg("vo_confidence"), F.lit(0.0)).alias("confidence_mean"),
    )
    reasons = reason_counts(df, keys, "vo_status_reason", order)
    top = reasons.groupBy(*keys).agg(
        F.min_by("vo_status_reason", F.struct(-F.col("n"), F.col("first_at"))).alias("dominant_reason"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("vo_status_reason", "n")))).alias("reason_counts"),
    )
    spread = exact_percentiles(df, keys, ["vo_confidence"], [0.1, 0.5, 0.9]).select(
        *keys,
        *[
            F.coalesce(f"vo_confidence_p{i}", F.lit(0.0)).alias(f"confidence_{n}")
            for i, n in enumerate(("p10", "p50", "p90"))
        ],
    )
    ratio = F.when(F.col("attempted") > 0, F.col("valid") / F.col("attempted")).otherwise(0.0)
    return base.withColumn("valid_ratio", ratio).join(top, keys).join(spread, keys)


# Reasons that mean odometry never ran.
BLOCKING_REASONS = ("calibration_unavailable", "projection_mode_unsupported", "vo_disabled_by_config")


def vo_runtime_summary(df: DataFrame, keys: Sequence[str] = ("video_id",), order: str = "frame_index") -> DataFrame:
    """Whether odometry ran at all, and the most frequent reason."""
    keys = list(keys)
    reason = F.coalesce("vo_status_reason", F.lit("unknown"))
    base = df.groupBy(*keys).agg(
        F.count_if("vo_attempted").alias("attempted"),
        F.count_if("vo_valid").alias("valid"),
        F.count_if("vo_pose_valid").alias("pose_valid"),
        F.bool_or(~reason.isin(*BLOCKING_REASONS)).alias("runtime_enabled"),
    )
    top = (
        reason_counts(df, keys, "vo_status_reason", order)
        .groupBy(*keys)
        .agg(F.min_by("vo_status_reason", F.struct(-F.col("n"), F.col("first_at"))).alias("runtime_reason"))
    )
    return base.join(top, keys)


def quantile_threshold(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    fixed: dict[str, float] | None = None,
    use_quantile: bool = True,
    quantile: float = 0.10,
) -> DataFrame:
    """``<column>_th`` per key: the fixed value, or a quantile of the finite values."""
    fixed = fixed or {}
    q = exact_percentiles(df, keys, columns, [min(max(quantile, 0.0), 1.0)])

    def threshold(c: str) -> Column:
        value = fixed.get(c)
        if value is not None and not use_quantile:
            return F.lit(float(value))
        return F.coalesce(F.col(f"{c}_p0"), F.lit(float(value or 0.0)))

    return q.select(*keys, *[threshold(c).alias(f"{c}_th") for c in columns])


def scan_summary(records: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Sampled frames, pass ratio and mean score of a scan."""
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if("is_pass").alias("passed"),
        (F.count_if("is_pass") / F.count(F.lit(1))).alias("pass_ratio"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
    )


def unreliable_switch(
    df: DataFrame,
    keys: Sequence[str] = ("video_id",),
    *,
    w_base: float = 0.70,
    w_trajectory: float = 0.25,
    min_ratio: float = 0.50,
    enabled: bool = True,
) -> DataFrame:
    """Stage weights per video; the trajectory weight moves to base when few steps are valid."""
    agg = df.groupBy(*keys).agg(F.count_if("vo_attempted").alias("attempted"), F.count_if("vo_valid").alias("valid"))
    ratio = F.when(F.col("attempted") > 0, F.col("valid") / F.col("attempted")).otherwise(0.0)
    off = F.lit(enabled) & (F.col("attempted") > 0) & (ratio < min(max(min_ratio, 0.0), 1.0)) & F.lit(w_trajectory > 0)
    return agg.select(
        *keys,
        ratio.alias("valid_ratio"),
        F.when(off, w_base + w_trajectory).otherwise(w_base).alias("w_base"),
        F.when(off, 0.0).otherwise(w_trajectory).alias("w_trajectory"),
    )


def pair_flow(a: str | Column, b: str | Column, how: str = "max") -> Column:
    """Combine the flow of two lenses."""
    return F.greatest(col(a), col(b)) if how == "max" else (col(a) + col(b)) * 0.5

