"""Stationary runs: hysteresis, run lengths, grace and penalty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.common import is_finite
from reelframe.functions.scores import confidence_band
from reelframe.plans.blocks import (
    BLOCK_ROWS,
    along,
    attach,
    following_min,
    halo_window,
    last_known,
    own_rows,
    previous,
    running_max,
    total,
    with_halo,
)

EXIT_SCALE = 1.25
MIN_MATCHES = 30


def hysteresis_masks(
    *,
    translation: str = "translation",
    rotation: str = "rotation",
    flow: str = "flow_mag",
    match_count: str = "match_count",
    min_matches: int = MIN_MATCHES,
    fallback: str = "not_stationary",
    exit_scale: float = EXIT_SCALE,
) -> tuple[Column, Column]:
    """(enter, stay) predicates against ``<column>_th`` thresholds."""
    reliable = is_finite(match_count) & (F.col(match_count) >= float(min_matches))

    def still(scale: float) -> Column:
        def below(c: str) -> Column:
            return is_finite(c) & F.coalesce(F.col(c) <= F.col(f"{c}_th") * scale, F.lit(False))

        flow_ok = below(flow)
        other = flow_ok if fallback == "flow_only" else F.lit(False)
        return F.when(reliable, below(translation) & below(rotation)).otherwise(other) & flow_ok

    return still(1.0), still(max(1.0, exit_scale))


def stationary_hysteresis(
    df: DataFrame, thresholds: DataFrame, keys: Sequence[str], order: str = "frame_index", **options
) -> DataFrame:
    """Add ``is_stationary``: entered below the thresholds, left above the wider ones.

    A row is stationary if the last entry lies after the last break. That needs
    two running maxima instead of a scan with state.
    """
    enter, stay = hysteresis_masks(**options)
    out = attach(df, thresholds, keys, F.col(order)).withColumn("_enter", enter).withColumn("_stay", stay)
    out = out.drop(*[c for c in thresholds.columns if c not in keys])
    at = F.col(order)
    out = along(
        out,
        keys,
        [order],
        {
            "_entered": running_max(F.when(F.col("_enter"), at)),
            "_broken": running_max(F.when(~F.col("_stay"), at)),
        },
    )
    since = F.col("_entered") > F.coalesce(F.col("_broken"), F.lit(-1))
    return out.withColumn("is_stationary", F.coalesce(since, F.lit(False))).drop("_enter", "_stay", "_entered", "_broken")


def run_bounds(df: DataFrame, keys: Sequence[str], order: str, flag: str, ordinal: str | None = None) -> DataFrame:
    """Add ``run_start`` and ``run_end`` ordinals of the run each flagged row is in.

    Rows outside runs get nulls. Both ends come from running extremes, so a run
    of any length never gathers in one task.
    """
    ordinal = ordinal or order
    pos = F.col(ordinal)
    out = along(
        df,
        keys,
        [order],
        {
            "_before": running_max(F.when(~F.col(flag), pos)),
            "_after": following_min(F.when(~F.col(flag), pos)),
            "_first": total("min", pos),
            "_last": total("max", pos),
        },
    )
    start = F.coalesce(F.col("_before") + 1, F.col("_first"))
    end = F.coalesce(F.col("_after") - 1, F.col("_last"))
    return out.withColumns(
        {"run_start": F.when(F.col(flag), start), "run_end": F.when(F.col(flag), end)}
    ).drop("_before", "_after", "_first", "_last")


def drop_short_runs(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "frame_index",
    *,
    fps: float = 30.0,
    seconds: float = 0.7,
    flag: str = "is_stationary",
    min_rows: int | None = None,
) -> DataFrame:
    """Clear runs of fewer than ``round(seconds * fps)`` rows; ``order`` is a dense ordinal."""
    need = max(1, int(round(seconds * max(fps, 1e-6)))) if min_rows is None else min_rows
    out = run_bounds(df, keys, order, flag)
    long_enough = (F.col("run_end") - F.col("run_start") + 1) >= need
    return out.withColumn(flag, F.coalesce(long_enough, F.lit(False))).drop("run_start", "run_end")


def boundary_grace(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str = "frame_index",
    *,
    grace: int = 2,
    flag: str = "is_stationary",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``is_boundary``: within ``grace`` rows of the first or last row of a run."""
    reach = grace + 1
    out = with_halo(df, ordinal, reach, reach, span=span)
    step = halo_window(keys, ordinal)
    on = F.col(flag)
    edge = on & ~(
        F.coalesce(F.lag(flag).over(step), F.lit(False)) & F.coalesce(F.lead(flag).over(step), F.lit(False))
    )
    out = out.withColumn("_edge", edge)
    near = F.max(F.col("_edge").cast("int")).over(step.rowsBetween(-grace, grace)) == 1
    return own_rows(out.withColumn("is_boundary", F.coalesce(near, F.lit(False)))).drop("_edge")


def stationary_penalty(
    candidates: DataFrame,
    flags: DataFrame,
    keys: Sequence[str],
    order: str = "frame_index",
    *,
    penalty: float = 0.7,
    soft: bool = True,
    score: str = "score",
) -> DataFrame:
    """Damp the score of stationary candidates; forced and boundary frames are exempt."""
    marks = flags.select(*keys, order, "is_stationary", "is_boundary")
    out = candidates.join(marks, [*keys, order], "left")
    still = F.coalesce("is_stationary", F.lit(False))
    hit = still & ~F.coalesce("is_boundary", F.lit(False)) & ~F.coalesce("is_forced", F.lit(False))
    factor = 1.0 - min(max(penalty, 0.0), 1.0) if soft else 0.0
    return (
        out.withColumn("is_stationary", still)
        .withColumn("stationary_penalty_applied", hit)
        .withColumn(score, F.when(hit, F.col(score) * factor).otherwise(F.col(score)))
        .drop("is_boundary")
    )


def stationary_ranges(
    df: DataFrame, keys: Sequence[str], order: str = "frame_index", *, flag: str = "is_stationary", report: str | None = None
) -> DataFrame:
    """First and last frame of every run; ``report`` names the frame number to return."""
    report = report or order
    runs = run_bounds(df, keys, order, flag).filter(F.col(flag))
    edge = runs.filter((F.col(order) == F.col("run_start")) | (F.col(order) == F.col("run_end")))
    return (
        edge.groupBy(*keys, "run_start")
        .agg(F.min(report).alias("first_frame"), F.max(report).alias("last_frame"))
        .drop("run_start")
    )


def confidence_regions(
    df: DataFrame, keys: Sequence[str], order: str = "frame_index", *, confidence: str = "confidence", **bands
) -> DataFrame:
    """Runs of low and of mid confidence: band, first frame, last frame + 1; dense ``order``."""
    out = df.withColumn("band", confidence_band(confidence, **bands))
    out = along(out, keys, [order], {"_prev": previous("band")})
    starts = F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("band")), F.col(order))
    out = out.withColumn("_start", starts)
    out = along(out, keys, [order], {"start_frame": last_known("_start")})
    return (
        out.filter(F.col("band") != "high")
        .groupBy(*keys, "band", "start_frame")
        .agg((F.max(order) + 1).alias("end_frame"))
    )
