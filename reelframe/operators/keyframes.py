"""Keyframe selection end to end: gate, chain, suppression, gap filling, re-scoring.

Each stage is written once and read by the next ones, so no stage is computed
twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions import scores as S
from reelframe.operators import selection as K
from reelframe.operators import stationary as St
from reelframe.operators.nearest import nearest_join
from reelframe.operators.quality import quality_gate, unreliable_switch
from reelframe.operators.trajectory import trajectory_consistency
from reelframe.plans.blocks import BLOCK_ROWS, along, assign_index, attach, previous
from reelframe.session import written_table


@dataclass(frozen=True)
class SelectionParams:
    """Settings of a run; intervals in frames, times in seconds."""

    quality_threshold: float = 0.50
    abs_laplacian_min: float = 35.0
    min_interval: int = K.MIN_INTERVAL
    max_interval: int = K.MAX_INTERVAL
    ssim_threshold: float = K.SSIM_THRESHOLD
    exposure_threshold: float | None = None
    nms_window: float = K.NMS_WINDOW
    max_gap_seconds: float = 2.0
    span: int = BLOCK_ROWS


def chain_scores(
    chain: DataFrame, score_pairs: Callable[[DataFrame], DataFrame], keys: Sequence[str], index: str = "frame_index", span: int = BLOCK_ROWS
) -> DataFrame:
    """Combined score of each chain member against the member before it."""
    keys = list(keys)
    linked = along(chain, keys, [index], {"ref_index": previous(index)}, span=span)
    pairs = score_pairs(linked.filter(F.col("ref_index").isNotNull()).select(*keys, "ref_index", index, *[c for c in ("brightness",) if c in chain.columns]))
    known = [c for c in ("ssim", "optical_flow", "gric", "feature_distribution_1", "feature_distribution_2", "ray_dispersion") if c in pairs.columns]
    out = chain.drop(*known).join(pairs.select(*keys, index, *known), [*keys, index], "left")
    geometry = ("gric", "feature_distribution_1", "feature_distribution_2", "ray_dispersion")
    have = lambda c: F.col(c) if c in known else F.lit(None).cast("double")
    return out.withColumn(
        "score",
        S.combined_score(
            "laplacian_var",
            "exposure",
            tuple(have(c) for c in geometry) if any(c in known for c in geometry) else None,
            (have("ssim"), have("optical_flow")) if {"ssim", "optical_flow"} & set(known) else None,
        ),
    )


def thin_and_fill(candidates: DataFrame, keys: Sequence[str], params: SelectionParams) -> DataFrame:
    """Suppress close candidates, then fill the gaps that are too long."""
    kept = written_table(K.nms(candidates, keys, window=params.nms_window), "nms")
    return K.fill_max_interval(kept, candidates, keys, max_seconds=params.max_gap_seconds, span=params.span)


def stage2_keyframes(
    frames: DataFrame,
    score_pairs: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = ("video_id",),
    params: SelectionParams = SelectionParams(),
    *,
    stationary: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, provisional keyframes) from raw frame metrics.

    ``frames`` has frame_index, timestamp_s and the raw quality fields; ``stationary`` optionally
    carries ``is_stationary`` and ``is_boundary`` per frame.
    """
    gated = quality_gate(frames, keys, threshold=params.quality_threshold, abs_min=params.abs_laplacian_min)
    passed = written_table(gated.filter("is_pass"), "stage1")
    chain = K.keyframe_chain(
        passed,
        score_pairs,
        keys,
        min_interval=params.min_interval,
        horizon=params.max_interval,
        ssim_threshold=params.ssim_threshold,
        exposure_threshold=params.exposure_threshold,
        span=params.span,
    )
    scored = chain_scores(written_table(chain, "chain"), score_pairs, keys, span=params.span)
    if stationary is not None:
        if "is_forced" not in scored.columns:
            scored = scored.withColumn("is_forced", F.lit(False))
        scored = St.stationary_penalty(scored, stationary, keys)
    candidates = written_table(scored, "stage2")
    return candidates, thin_and_fill(candidates, keys, params)


def stage3_keyframes(
    candidates: DataFrame,
    keyframes: DataFrame,
    steps: DataFrame,
    motion: DataFrame,
    keys: Sequence[str] = ("video_id",),
    params: SelectionParams = SelectionParams(),
) -> DataFrame:
    """Re-score the candidates with their trajectory and select again.

    ``steps`` holds odometry per tracked frame, ``motion`` has ``motion_risk`` on sampled frames.
    """
    keys = list(keys)
    tracked = K.union_distinct(candidates, keyframes, [*keys, "frame_index"])
    tracked = assign_index(tracked, keys, ["frame_index"], "ordinal").join(steps, [*keys, "frame_index"], "left")
    tracked = tracked.withColumns(
        {
            "vo_valid": F.coalesce("vo_valid", F.lit(False)),
            "vo_attempted": F.coalesce("vo_attempted", F.lit(False)),
            "step_proxy": F.coalesce("step_proxy", F.lit(0.0)),
            "rotation_delta_deg": F.coalesce("rotation_delta_deg", F.lit(0.0)),
            "t_dir": F.coalesce("t_dir", F.array(*[F.lit(0.0)] * 3)),
        }
    )
    tracked = written_table(trajectory_consistency(tracked, keys, "ordinal"), "tracked")
    weights = unreliable_switch(tracked, keys)
    risk = nearest_join(candidates, motion.select(*keys, "frame_index", "motion_risk"), keys, "frame_index", dense=True)
    traj = tracked.select(*keys, "frame_index", "trajectory_consistency", F.col("vo_confidence").alias("_conf"))
    out = attach(risk.join(traj, [*keys, "frame_index"], "left"), weights, keys, F.col("frame_index"))
    out = out.withColumn(
        "score",
        S.stage3_score("score", "trajectory_consistency", "_conf", "r_motion_risk", F.col("w_base"), F.col("w_trajectory")),
    )
    rescored = written_table(out.select(*candidates.columns, "trajectory_consistency"), "stage3")
    return thin_and_fill(rescored, keys, params)
