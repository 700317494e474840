"""The selection from raw metrics to keyframes as one query each."""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import query
from reelframe.catalogue.quality import gate_cte
from reelframe.catalogue.sequences import _ISLANDS, DAY, KEYS, _T_DIR, _flagged
from reelframe.catalogue.views import with_views
from reelframe.functions import scores as S
from reelframe.operators import keyframes as E
from reelframe.operators.selection_run import selection_stages
from reelframe.session import scratch_root, written_table
from reelframe.sources.frames import sample_frames
from reelframe.sources.runs import Input, RunStore, files_fingerprint, run_stages

PARAMS = E.SelectionParams(
    quality_threshold=0.5,
    abs_laplacian_min=35.0,
    min_interval=2,
    max_interval=24,
    ssim_threshold=0.8,
    nms_window=1.5 * DAY,
    max_gap_seconds=4 * DAY,
    span=48,
)


def _scorer(df):
    ref = df.select(*KEYS, F.col("frame_index").alias("ref_index"), F.col("brightness").alias("_ra"), F.col("flow_mag").alias("_fa"))
    cur = df.select(*KEYS, "frame_index", F.col("brightness").alias("_rb"), F.col("flow_mag").alias("_fb"))

    def score(pairs):
        out = pairs.join(ref, [*KEYS, "ref_index"]).join(cur, [*KEYS, "frame_index"])
        return (
            out.withColumn("ssim", 1 - F.abs(F.col("_ra") - F.col("_rb")))
            .withColumn("optical_flow", F.abs(F.col("_fa") - F.col("_fb")))
            .drop("_ra", "_rb", "_fa", "_fb")
        )

    return score


_STAGE2_SQL = (
    ", "
    + gate_cte("frames_v", 35.0)
    + """, pass AS (SELECT video_id, frame_index AS f, timestamp_s AS t, brightness AS b, flow_mag AS fl, laplacian_var AS lap, exposure AS ex
      FROM gated WHERE drop_reason = 'pass'),
    chain AS (SELECT video_id, min(f) AS f FROM pass GROUP BY video_id
      UNION ALL SELECT c.video_id, min(p.f) FROM chain c JOIN pass i ON i.video_id = c.video_id AND i.f = c.f
      JOIN pass p ON p.video_id = c.video_id AND p.f >= c.f + 2 AND 1 - abs(p.b - i.b) <= 0.8 GROUP BY c.video_id),
    linked AS (SELECT p.*, lag(p.b) OVER w AS rb, lag(p.fl) OVER w AS rf FROM chain c JOIN pass p ON p.video_id = c.video_id AND p.f = c.f
      WINDOW w AS (PARTITION BY p.video_id ORDER BY p.f)),
    cand AS (SELECT video_id, f, t, 0.3 * least(lap / 1000, 1) + 0.15 * ex + 0.15 + 0.25 * CASE WHEN rb IS NULL THEN 0.5
      ELSE (abs(b - rb) + least(abs(fl - rf) / 50, 1)) / 2 END AS score FROM linked),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, f) AS r FROM cand),
    fold AS (SELECT video_id, r, f, t, score, true AS keep, [t] AS kept FROM ranked WHERE r = 1
      UNION ALL SELECT video_id, r, f, t, score, ok, CASE WHEN ok THEN list_append(kept, t) ELSE kept END FROM (
        SELECT n.*, z.kept, len(list_filter(z.kept, lambda k: abs(k - n.t) < 129600)) = 0 AS ok
        FROM fold z JOIN ranked n ON n.video_id = z.video_id AND n.r = z.r + 1) q),
    gaps AS (SELECT video_id, f AS last, t AS last_t, lead(f) OVER w AS f1, lead(t) OVER w AS t1 FROM fold WHERE keep
      WINDOW w AS (PARTITION BY video_id ORDER BY f)),
    fill AS (SELECT * FROM gaps UNION ALL SELECT video_id, pick.f, pick.t, f1, t1 FROM (
      SELECT l.video_id, l.last, l.f1, l.t1, arg_min({'f': c.f, 't': c.t}, (abs(c.t - (l.last_t + 345600)), -c.score, c.f)) AS pick
      FROM fill l JOIN cand c ON c.video_id = l.video_id AND c.f > l.last AND c.f < l.f1 WHERE l.t1 - l.last_t > 345600 GROUP BY ALL) q)"""
)


def _inputs(spark, sf):
    return written_table(V.frames(spark, sf), "frames")


@query(
    "select_keyframes",
    "video_id:l frame_index:l score:d",
    with_views(
        _STAGE2_SQL + " SELECT DISTINCT c.video_id, c.f AS frame_index, c.score FROM fill JOIN cand c ON c.video_id = fill.video_id AND c.f = fill.last",
        recursive=True,
    ),
)
def _select_keyframes(spark, sf):
    df = _inputs(spark, sf)
    return E.stage2_keyframes(df, _scorer(df), KEYS, PARAMS)[1]


@query("select_keyframes_with_trajectory", "video_id:l frame_index:l score:d trajectory_consistency:d")
def _select_with_trajectory(spark, sf):
    df = _inputs(spark, sf)
    candidates, keyframes = E.stage2_keyframes(df, _scorer(df), KEYS, PARAMS)
    keyframes = written_table(keyframes, "provisional")
    steps = df.select(
        *KEYS,
        "frame_index",
        "vo_valid",
        "vo_attempted",
        "step_proxy",
        F.col("rotation_delta").alias("rotation_delta_deg"),
        F.array(*[F.expr(e).cast("double") for e in _T_DIR]).alias("t_dir"),
        F.col("inlier_ratio").alias("vo_confidence"),
    )
    motion = sample_frames(df, step=5).select(*KEYS, "frame_index", S.motion_risk("laplacian_var", "flow_mag", "ssim").alias("motion_risk"))
    return E.stage3_keyframes(candidates, keyframes, steps, motion, KEYS, PARAMS)


_HEAD, _TAIL = _STAGE2_SQL.split("ranked AS", 1)
# The same selection with damped stationary candidates; two runs of at most so many keyframes a video.
_RUN_SQL = (
    _HEAD.replace("cand AS (", "cand0 AS (")
    + _ISLANDS.removeprefix(", ")
    + """, long AS (SELECT * FROM runs WHERE b - a + 1 >= 3),
    cand AS (SELECT video_id, f, t, CASE WHEN still AND NOT edge THEN score * 0.3 ELSE score END AS score, still
      FROM (SELECT *, EXISTS (SELECT 1 FROM long r WHERE r.video_id = cand0.video_id AND f BETWEEN a AND b) AS still,
        EXISTS (SELECT 1 FROM long r WHERE r.video_id = cand0.video_id AND (abs(f - a) <= 1 OR abs(f - b) <= 1)) AS edge FROM cand0) q),
    ranked AS"""
    + _TAIL
    + """, final AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS place
      FROM (SELECT DISTINCT c.video_id, c.f AS frame_index, c.score, c.still AS is_stationary FROM fill JOIN cand c ON c.video_id = fill.video_id AND c.f = fill.last))"""
)


def _compared(ref, rows):
    return {"ssim": 1 - np.abs(rows["brightness"] - ref["brightness"])}


def _selection_run(spark, sf, store, top_k):
    df = _inputs(spark, sf)
    motion = _flagged(spark, sf).select(*KEYS, "frame_index", "is_stationary")
    made_from = files_fingerprint(spark, f"{sf}/events.parquet")
    params = replace(PARAMS, exposure_threshold=None)
    stages = selection_stages(_compared, _scorer(df), ["brightness"], KEYS, params, min_still_rows=3, grace=1, top_k=top_k)
    return run_stages(store, stages, {"frames": Input(df, made_from), "motion": Input(motion, made_from)})


def _new_store(spark):
    return RunStore(spark, f"{scratch_root(spark)}/reelframe-{spark.sparkContext.applicationId}/runs-{uuid.uuid4().hex}", "a run")


@query(
    "selection_run",
    "video_id:l frame_index:l score:d is_stationary:b",
    with_views(_RUN_SQL + " SELECT video_id, frame_index, score, is_stationary FROM final WHERE place <= 6", recursive=True),
)
def _selection(spark, sf):
    return _selection_run(spark, sf, _new_store(spark), 6).tables["3"]


@query(
    "resumed_run",
    "run:l stage:s computed:b rows:l",
    with_views(
        _RUN_SQL
        + """, n AS (SELECT unnest([1, 2, 3]) AS run, unnest([6, 6, 4]) AS k),
        counts AS (SELECT '1' AS stage, count(*) AS rows FROM pass UNION ALL SELECT '0', count(*) FROM frames_v UNION ALL SELECT '2', count(*) FROM cand)
        SELECT run, stage, run = 1 AS computed, rows FROM n, counts
        UNION ALL SELECT run, '3', run <> 2, (SELECT count(*) FROM final WHERE place <= k) FROM n""",
        recursive=True,
    ),
)
def _resumed(spark, sf):
    """A run, the same again, and one with another number of keyframes, over the same stored stages."""
    store, out = _new_store(spark), []
    for run, top_k in ((1, 6), (2, 6), (3, 4)):
        result = _selection_run(spark, sf, store, top_k)
        out += [(run, stage, stage in result.computed, rows) for stage, rows in result.rows.items()]
    return spark.createDataFrame(out, "run int, stage string, computed boolean, rows bigint")
