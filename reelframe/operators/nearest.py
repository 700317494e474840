"""Nearest joins between two sequences of the same video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.plans.blocks import BLOCK_ROWS, along, index_block, last_known, next_known, ranged


def neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    on: str,
    right_on: str | None = None,
    *,
    dense: bool = False,
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Left rows with ``back`` (last right row at or before) and ``ahead`` (next one).

    Both sides are merged into one sequence, so the work is linear in their sizes.
    ``right`` is unique per (keys, ``right_on``). ``dense`` promises that ``on`` is
    an integer index, so plain index blocks are balanced; otherwise sampled
    ranges are used.
    """
    keys, right_on = list(keys), right_on or on
    payload = F.struct(F.col(right_on).alias("_key"), *[c for c in right.columns if c not in keys])
    a = left.withColumn("_at", F.col(on)).withColumn("_side", F.lit(1))
    b = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), payload.alias("_right"))
    both = a.unionByName(b, allowMissingColumns=True)
    if dense:
        both = both.withColumn("_block", index_block("_at", span))
    else:
        both = ranged(both, keys, ["_at", "_side"]).drop("_pos")
    both = along(
        both,
        keys,
        ["_at", "_side"],
        {"back": last_known(F.col("_right")), "ahead": next_known(F.col("_right"))},
        block="_block",
    )
    return both.filter(F.col("_side") == 1).drop("_at", "_side", "_right", "_block")


def nearest_pick(on: str | Column) -> Column:
    """The nearer of ``back`` and ``ahead``; a tie goes to the earlier one."""
    on = F.col(on) if isinstance(on, str) else on
    return (
        F.when(F.col("ahead").isNull(), F.col("back"))
        .when(F.col("back").isNull(), F.col("ahead"))
        .when(on - F.col("back._key") <= F.col("ahead._key") - on, F.col("back"))
        .otherwise(F.col("ahead"))
    )


def nearest_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    on: str,
    right_on: str | None = None,
    *,
    prefix: str = "r_",
    dense: bool = False,
) -> DataFrame:
    """Each left row with its nearest right row, clamped at both ends.

    Adds ``gap`` (absolute distance) and the right columns under ``prefix``; all
    are null where the key has no right row.
    """
    right_on = right_on or on
    payload = [c for c in right.columns if c not in keys]
    hit = neighbours(left, right, keys, on, right_on, dense=dense).withColumn("_hit", nearest_pick(on))
    return hit.select(
        *left.columns,
        F.abs(F.col(on) - F.col("_hit._key")).alias("gap"),
        *[F.col(f"_hit.{c}").alias(prefix + c) for c in payload],
    )


def nearest_within(left, right, keys, on, right_on=None, *, ttl, prefix="r_", dense=False) -> DataFrame:
    """As :func:`nearest_join`, with the right side null beyond ``ttl``."""
    out = nearest_join(left, right, keys, on, right_on, prefix=prefix, dense=dense)
    ok = F.col("gap") <= F.lit(ttl)
    return out.select(
        *left.columns,
        *[F.when(ok, F.col(c)).alias(c) for c in out.columns if c not in left.columns],
    )


# Columns a motion row may overwrite in a later stage's row.
MOTION_COLUMNS = (
    "translation_delta",
    "rotation_delta",
    "match_count",
    "vo_step_proxy",
    "vo_step_proxy_norm",
    "vo_inlier_ratio",
    "vo_rot_deg",
    "vo_confidence",
    "vo_feature_uniformity",
    "vo_track_sufficiency",
    "vo_pose_plausibility",
    "vo_tracked_count",
    "vo_essential_method",
    "vo_status_reason",
)


def inject_motion(frames: DataFrame, motion: DataFrame, keys: Sequence[str], on: str = "frame_index") -> DataFrame:
    """Overwrite the motion columns of each frame with the nearest motion row's."""
    present = [c for c in MOTION_COLUMNS if c in motion.columns]
    out = nearest_join(frames, motion.select(*keys, on, *present), keys, on, dense=True)
    old = [
        F.coalesce(F.col(f"r_{c}"), F.col(c)).alias(c) if c in present else F.col(c) for c in frames.columns
    ]
    new = [F.col(f"r_{c}").alias(c) for c in present if c not in frames.columns]
    return out.select(*old, *new)


def nearest_pose(frames: DataFrame, poses: DataFrame, keys: Sequence[str], on: str = "frame_index") -> DataFrame:
    """Own or nearest pose; ``vo_pose_valid`` only where the frame has its own."""
    out = nearest_join(frames, poses, keys, on, prefix="pose_", dense=True)
    return out.withColumn("vo_pose_valid", F.coalesce(F.col("gap") == 0, F.lit(False))).drop("gap", f"pose_{on}")


def frame_score_merge(
    frames: DataFrame, keys: Sequence[str], parts: Sequence[tuple[DataFrame, dict[str, object]]]
) -> DataFrame:
    """Left-join per-frame tables onto all frames with a default per column.

    ``keys`` identify a frame, so every join key is unique on the right.
    """
    out = frames
    for part, defaults in parts:
        out = out.join(part.select(*keys, *defaults), list(keys), "left").withColumns(
            {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if v is not None}
        )
    return out


def mark_keyframes(frames: DataFrame, keyframes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag the frames that occur in ``keyframes``."""
    marks = keyframes.select(*keys).distinct().withColumn("is_keyframe", F.lit(True))
    return frames.join(marks, list(keys), "left").withColumn(
        "is_keyframe", F.coalesce("is_keyframe", F.lit(False))
    )
