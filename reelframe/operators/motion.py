"""Changes between neighbouring frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.common import clip
from reelframe.plans.blocks import BLOCK_ROWS, along, halo_window, last_known_before, own_rows, previous, with_halo


def brightness_jump(
    df: DataFrame, keys: Sequence[str], order: str = "frame_index", *, threshold: float = 0.3, value: str = "brightness"
) -> DataFrame:
    """Flag frames whose brightness differs from the previous frame's by more than ``threshold``."""
    out = along(df, keys, [order], {"_prev": previous(value)})
    jump = F.abs(F.col(value) - F.col("_prev")) > threshold
    return out.withColumn("exposure_changed", F.coalesce(jump, F.lit(False))).drop("_prev")


def rescue_mode(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    *,
    window: int = 10,
    threshold: float = 15.0,
    count: str = "match_count",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """True once the last ``window`` match counts exist and average below ``threshold``.

    ``ordinal`` numbers the recorded estimations densely; failed ones count as 0.
    """
    w = halo_window(keys, ordinal).rowsBetween(-(window - 1), 0)
    out = with_halo(df, ordinal, window - 1, 0, span=span)
    out = out.withColumn(
        "is_rescue_mode",
        (F.count(F.lit(1)).over(w) >= window) & (F.avg(F.coalesce(F.col(count), F.lit(0.0))).over(w) < threshold),
    )
    return own_rows(out)


def momentum(
    df: DataFrame, keys: Sequence[str], ordinal: str, *, frames: int = 5, flow: str = "flow_mag", span: int = BLOCK_ROWS
) -> DataFrame:
    """Mean absolute change of successive flows inside the last ``frames`` frames.

    ``flow`` is the flow from the previous frame to this one, so a window of
    ``frames`` frames holds ``frames - 1`` flows and ``frames - 2`` changes.
    """
    step = halo_window(keys, ordinal)
    recent = step.rowsBetween(-(frames - 3), 0)
    out = with_halo(df, ordinal, frames - 1, 0, span=span)
    first = F.col(ordinal) <= 1
    change = F.when(~first, F.abs(F.col(flow) - F.lag(flow).over(step)))
    out = out.withColumn("_change", change)
    out = out.withColumn("momentum", F.coalesce(F.avg("_change").over(recent), F.lit(0.0)))
    return own_rows(out).drop("_change")


def pose_plausibility(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "frame_index",
    *,
    rotation: str = "rotation_delta_deg",
    step: str = "step_proxy",
    valid: str = "vo_valid",
) -> DataFrame:
    """Small rotation and a step close to the previous valid one; null on invalid rows."""
    out = along(df, keys, [order], {"_prev": last_known_before(F.when(F.col(valid), F.greatest(F.col(step), F.lit(0.0))))})
    prev, cur = F.col("_prev"), F.greatest(F.col(step), F.lit(0.0))
    out = out.withColumn("pose_plausibility", F.when(F.col(valid), plausibility(F.col(rotation), cur, prev)))
    return out.drop("_prev")


def plausibility(rotation: Column, step: Column, prev: Column) -> Column:
    turn = clip(1.0 - F.abs(rotation) / 30.0, 0.0, 1.0)
    known = prev.isNotNull() & (prev > 1e-12) & (step > 1e-12)
    ratio = F.when(known, clip(1.0 - F.abs(F.log(step) - F.log(prev)), 0.0, 1.0)).otherwise(0.5)
    return clip(0.5 * turn + 0.5 * ratio, 0.0, 1.0)
