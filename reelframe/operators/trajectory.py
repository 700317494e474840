"""Relative poses to trajectories and their consistency."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions.common import clip, is_finite
from reelframe.functions.pose import dot, norm, unit
from reelframe.plans.blocks import (
    BLOCK_ROWS,
    along,
    attach,
    in_tasks,
    index_block,
    last_known,
    previous,
    running_count,
    running_sum,
    total,
    total_first,
)
from reelframe.plans.percentiles import exact_percentiles
from reelframe.session import written_table


def median_step(df: DataFrame, keys: Sequence[str], *, step: str = "step_proxy", valid: str = "vo_valid") -> DataFrame:
    """``step_median`` of the positive valid steps per video; 1 if there is none."""
    steps = df.select(*keys, F.when(F.col(valid) & (F.col(step) > 0), F.col(step)).alias("step"))
    q = exact_percentiles(steps, keys, ["step"], [0.5])
    median = F.when(F.col("step_p0") > 1e-12, F.col("step_p0")).otherwise(1.0)
    return q.select(*keys, median.alias("step_median"))


def step_norm(
    df: DataFrame, keys: Sequence[str], *, step: str = "step_proxy", valid: str = "vo_valid", order: str = "frame_index"
) -> DataFrame:
    """Each positive step relative to the video's median step."""
    out = attach(df, median_step(df, keys, step=step, valid=valid), keys, F.col(order))
    return out.withColumn(
        "step_norm", F.when(F.col(step) > 0, F.col(step) / F.col("step_median")).otherwise(0.0)
    ).drop("step_median")


def trajectory_consistency(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str = "frame_index",
    *,
    step_clip: float = 80.0,
    vo_enabled: bool = True,
) -> DataFrame:
    """Agreement of each valid step with the one right before it.

    Columns: ``vo_valid``, ``t_dir``, ``rotation_delta_deg``, ``step_proxy``; ``ordinal``
    numbers the rows from 0 and the first row has no step of its own.
    """
    if not vo_enabled:
        return df.withColumn("trajectory_consistency", F.lit(0.5))
    pos = F.col(ordinal)
    step = F.greatest(F.col("step_proxy"), F.lit(0.0))
    if step_clip > 0:
        step = F.least(step, F.lit(step_clip))
    now = F.struct(
        (F.col("vo_valid") & (pos > 0)).alias("valid"),
        unit(F.col("t_dir")).alias("dir"),
        F.col("rotation_delta_deg").alias("rot"),
        step.alias("step"),
    )
    out = df.withColumn("_now", now)
    out = along(
        out, keys, [ordinal], {"_prev": previous("_now"), "_seen": running_count(F.col("_now.valid"))}
    )
    cur, prev = F.col("_now"), F.col("_prev")
    follows = F.coalesce(prev["valid"], F.lit(False))
    turn = clip((clip(dot(cur["dir"], prev["dir"]), -1.0, 1.0) + 1.0) * 0.5, 0.0, 1.0)
    rot = clip(1.0 - F.abs(cur["rot"] - prev["rot"]) / 15.0, 0.0, 1.0)
    moved = (cur["step"] > 1e-12) & (prev["step"] > 1e-12)
    size = F.when(moved, clip(1.0 - F.abs(F.log(cur["step"]) - F.log(prev["step"])), 0.0, 1.0)).otherwise(0.5)
    half = F.lit(0.5)
    terms = [F.when(follows, t).otherwise(half) for t in (turn, rot, size)]
    ratio = clip(F.col("_seen") / pos, 0.0, 1.0)
    value = clip(0.4 * ratio + 0.2 * terms[0] + 0.2 * terms[1] + 0.2 * terms[2], 0.0, 1.0)
    score = F.when(pos == 0, 0.5).when(cur["valid"], value).otherwise(0.0)
    return out.withColumn("trajectory_consistency", score).drop("_now", "_prev", "_seen")


def _quat_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w1, x1, y1, z1 = a.T
    w2, x2, y2, z2 = b.T
    return np.stack(
        [
            w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
            w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
            w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
            w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
        ],
        axis=1,
    )


def _rotate(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    axis = q[:, 1:]
    t = 2.0 * np.cross(axis, v)
    return v + q[:, :1] * t + np.cross(axis, t)


def _unit_rows(q: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(q, axis=1, keepdims=True)
    return np.where(n > 1e-12, q / np.where(n > 1e-12, n, 1.0), [1.0, 0.0, 0.0, 0.0])


def _piece_starts(pdf: pd.DataFrame, piece: Sequence[str]) -> np.ndarray:
    """Row at which each row's piece begins; rows of a piece are adjacent."""
    number = pdf.groupby(list(piece), sort=False).ngroup().to_numpy()
    fresh = np.r_[True, number[1:] != number[:-1]]
    return np.flatnonzero(fresh)[np.cumsum(fresh) - 1]


def _scan(values: np.ndarray, starts: np.ndarray, combine: Callable) -> np.ndarray:
    """Inclusive scan inside every piece by doubling; ``combine`` is associative."""
    out, place, d = values.copy(), np.arange(len(values)) - starts, 1
    while (rows := np.flatnonzero(place >= d)).size:
        out[rows] = combine(out[rows - d], out[rows])
        d *= 2
    return out


def _turns(q: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _scan(q, starts, lambda a, b: _unit_rows(_quat_mul(a, b)))


def _shifted(values: np.ndarray, starts: np.ndarray, first: Sequence[float]) -> np.ndarray:
    """Value of the row before inside the piece, ``first`` on its first row."""
    out = np.roll(values, 1, axis=0)
    out[starts] = first
    return out


def _canonical(q: np.ndarray) -> np.ndarray:
    """Sign under which a matrix is usually turned into a quaternion: w > 0 for small
    rotations, otherwise the largest of x, y, z positive."""
    s = q * q
    lead = np.where(
        4.0 * s[:, 0] > 1.0,
        0,
        np.where((s[:, 1] > s[:, 2]) & (s[:, 1] > s[:, 3]), 1, np.where(s[:, 2] > s[:, 3], 2, 3)),
    )
    return q * np.where(q[np.arange(len(q)), lead] < 0, -1.0, 1.0)[:, None]


def _steps(pdf: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the rotation up to it and the position after it, both from the piece's start."""
    valid = pdf["vo_valid"].to_numpy(bool)
    q = _unit_rows(np.stack(pdf["q_rel"].to_numpy()).astype(float))
    q[~valid] = [1.0, 0.0, 0.0, 0.0]
    turn = _turns(q, starts)
    moved = _rotate(turn, np.stack(pdf["t_step"].to_numpy()).astype(float))
    return turn, _scan(moved, starts, np.add)


_POSE = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]


def integrate_trajectory(
    df: DataFrame,
    keys: Sequence[str],
    order: str = "frame_index",
    *,
    t_sign: float = 1.0,
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """World poses from relative steps: ``t_xyz``, ``q_wxyz``, ``step_norm`` per row.

    Columns: ``vo_valid``, ``q_rel``, ``t_dir``, ``step_proxy``. Rigid motions compose
    associatively, so each block is reduced to one motion, the few block motions
    are chained per video, and every block then starts from its own pose.
    """
    keys = list(keys)
    steps = attach(df, median_step(df, keys), keys, F.col(order))
    moves = F.col("vo_valid") & (norm(F.col("t_dir"), 3) > 1e-12)
    size = F.when(moves, F.greatest(F.col("step_proxy"), F.lit(0.0)) / F.col("step_median")).otherwise(0.0)
    zero = F.array(*[F.lit(0.0)] * 3)
    steps = steps.withColumn("step_norm", size).select(
        *keys,
        F.col(order).alias("_at"),
        "vo_valid",
        "q_rel",
        F.when(moves, F.transform(unit(F.col("t_dir")), lambda x: x * F.col("step_norm") * t_sign))
        .otherwise(zero)
        .alias("t_step"),
        "step_norm",
        index_block(order, span).alias("_block"),
    )
    steps = written_table(steps, "steps")
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    pose_ddl = ", ".join(f"{c} double" for c in _POSE)
    piece = [*keys, "_block"]
    block_cols = [*piece, *_POSE]

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*piece, "_at"], ignore_index=True)
        starts = _piece_starts(pdf, piece)
        turn, at = _steps(pdf, starts)
        last = np.r_[starts[1:] != starts[:-1], True]
        out = pdf.loc[last, piece].copy()
        out[_POSE] = np.hstack([turn, at])[last]
        return out[block_cols]

    def chain_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(piece, ignore_index=True)
        starts = _piece_starts(pdf, keys)
        before = _shifted(_turns(pdf[_POSE[:4]].to_numpy(float), starts), starts, [1.0, 0.0, 0.0, 0.0])
        moved = _scan(_rotate(before, pdf[_POSE[4:]].to_numpy(float)), starts, np.add)
        pdf[_POSE] = np.hstack([before, _shifted(moved, starts, [0.0, 0.0, 0.0])])
        return pdf[block_cols]

    def finish_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*piece, "_at"], ignore_index=True)
        turn, at = _steps(pdf, _piece_starts(pdf, piece))
        start = pdf[_POSE[:4]].to_numpy(float)
        out = pdf[[*keys, "_at", "step_norm"]].copy()
        out["t_xyz"] = list(pdf[_POSE[4:]].to_numpy(float) + _rotate(start, at))
        out["q_wxyz"] = list(_canonical(_unit_rows(_quat_mul(start, turn))))
        return out[[*keys, "_at", "t_xyz", "q_wxyz", "step_norm"]]

    blocks = in_tasks(steps, piece).applyInPandas(reduce_block, f"{key_ddl}, _block bigint, {pose_ddl}")
    blocks = written_table(blocks, "block-motions")
    starts = in_tasks(blocks, keys).applyInPandas(chain_blocks, f"{key_ddl}, _block bigint, {pose_ddl}")
    poses = in_tasks(steps.join(starts, piece), piece, size=steps.count()).applyInPandas(
        finish_block, f"{key_ddl}, _at bigint, t_xyz array<double>, q_wxyz array<double>, step_norm double"
    )
    return poses.withColumnRenamed("_at", order)


def fill_pose_forward(df: DataFrame, keys: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Hold the last valid position, relative to the first frame's; zeros before it.

    Columns: ``vo_pose_valid``, ``t_xyz``. Videos with fewer than two valid poses
    get null positions (see :func:`pseudo_trajectory`).
    """
    ok = F.col("vo_pose_valid") & (F.size("t_xyz") == 3) & F.forall("t_xyz", is_finite)
    out = df.withColumn("_pose", F.when(ok, F.col("t_xyz"))).withColumn(
        "_held", F.struct(F.col("_pose").alias("p"))
    )
    out = along(
        out,
        keys,
        [order],
        {"_known": last_known("_pose"), "_origin": total_first("_held"), "_valid": total("count", F.col("_pose"))},
    )
    zero = F.array(*[F.lit(0.0)] * 3)
    origin = F.coalesce(F.col("_origin.p"), zero)
    path = F.zip_with(F.coalesce("_known", zero), origin, lambda a, b: a - b)
    return out.withColumn("path_xyz", F.when(F.col("_valid") >= 2, path)).drop("_pose", "_held", "_known", "_origin", "_valid")


def pseudo_trajectory(
    df: DataFrame, keys: Sequence[str], ordinal: str = "frame_index", *, flow: str = "flow_mag", rotation: str = "rotation_delta"
) -> DataFrame:
    """Dead reckoning without odometry: heading from rotations, step length from flow."""
    cap = exact_percentiles(df, keys, [flow], [0.95]).select(*keys, F.col(f"{flow}_p0").alias("_cap"))
    out = attach(df, cap, keys, F.col(ordinal))
    moving = F.col(ordinal) > 0
    out = out.withColumn("_step", F.when(moving, clip(flow, F.lit(0.0), F.col("_cap")) * 0.03).otherwise(0.0))
    out = out.withColumn("_turn", F.when(moving, F.radians(clip(rotation, 0.0, 30.0))).otherwise(0.0))
    out = along(out, keys, [ordinal], {"_theta": running_sum("_turn")})
    theta, step = F.col("_theta"), F.col("_step")
    out = along(
        out,
        keys,
        [ordinal],
        {
            "x": running_sum(step * F.cos(theta)),
            "y": running_sum(step * F.sin(theta * 0.25) * 0.5),
            "z": running_sum(step * F.sin(theta)),
        },
    )
    return out.drop("_cap", "_step", "_turn", "_theta")
