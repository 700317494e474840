"""Queries over frame sequences: windows, nearest joins, selection, trajectories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import query
from reelframe.catalogue.views import with_views
from reelframe.functions import scores as S
from reelframe.operators import motion as M
from reelframe.operators import nearest as N
from reelframe.operators import pairs as P
from reelframe.operators import quality as O
from reelframe.operators import selection as K
from reelframe.operators import stationary as St
from reelframe.operators import trajectory as T
from reelframe.operators.chain_scan import ChainRules, keyframe_scan
from reelframe.session import written_table

KEYS = ["video_id"]
DAY = 86400.0


@query(
    "brightness_jump",
    "video_id:l frame_index:l exposure_changed:b",
    with_views(
        """SELECT video_id, frame_index, coalesce(abs(brightness - lag(brightness) OVER
        (PARTITION BY video_id ORDER BY frame_index)) > 0.3, false) AS exposure_changed FROM frames_v"""
    ),
)
def _brightness_jump(spark, sf):
    return M.brightness_jump(V.frames(spark, sf), KEYS)


@query(
    "rescue_mode",
    "video_id:l frame_index:l is_rescue_mode:b",
    with_views(
        """SELECT video_id, frame_index, count(*) OVER w >= 10 AND avg(match_count) OVER w < 45 AS is_rescue_mode
        FROM frames_v WINDOW w AS (PARTITION BY video_id ORDER BY frame_index ROWS 9 PRECEDING)"""
    ),
)
def _rescue_mode(spark, sf):
    return M.rescue_mode(V.frames(spark, sf), KEYS, "frame_index", threshold=45.0)


@query(
    "momentum",
    "video_id:l frame_index:l momentum:d",
    with_views(
        """, c AS (SELECT *, CASE WHEN frame_index > 1 THEN abs(flow_mag - lag(flow_mag) OVER
          (PARTITION BY video_id ORDER BY frame_index)) END AS change FROM scan_v)
        SELECT video_id, frame_index, coalesce(avg(change) OVER
          (PARTITION BY video_id ORDER BY frame_index ROWS 2 PRECEDING), 0) AS momentum FROM c"""
    ),
)
def _momentum(spark, sf):
    return M.momentum(V.scan(spark, sf), KEYS, "frame_index")


@query(
    "pose_plausibility",
    "video_id:l frame_index:l pose_plausibility:d",
    with_views(
        """, p AS (SELECT *, last_value(CASE WHEN vo_valid THEN step_proxy END IGNORE NULLS) OVER (PARTITION BY video_id
          ORDER BY frame_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM frames_v)
        SELECT video_id, frame_index, CASE WHEN vo_valid THEN 0.5 * least(greatest(1 - abs(rotation_delta) / 30, 0), 1)
          + 0.5 * CASE WHEN prev > 1e-12 AND step_proxy > 1e-12
            THEN least(greatest(1 - abs(ln(step_proxy) - ln(prev)), 0), 1) ELSE 0.5 END END AS pose_plausibility FROM p"""
    ),
)
def _pose_plausibility(spark, sf):
    return M.pose_plausibility(V.frames(spark, sf), KEYS, rotation="rotation_delta")


_STILL_OPTIONS = dict(translation="step_proxy", rotation="rotation_delta", flow="flow_mag", min_matches=10)


@query(
    "stationary_hysteresis",
    "video_id:l frame_index:l is_stationary:b",
    with_views(
        """, o AS (SELECT video_id, 0.6::DOUBLE * (count(*) - 1) AS h, list_sort(list(step_proxy)) AS lt, list_sort(list(rotation_delta)) AS lr,
          list_sort(list(flow_mag)) AS lf FROM frames_v GROUP BY video_id),
        ends AS (SELECT *, lt[CAST(floor(h) AS BIGINT) + 1] AS t0, lt[CAST(ceil(h) AS BIGINT) + 1] AS t1, lr[CAST(floor(h) AS BIGINT) + 1] AS r0,
          lr[CAST(ceil(h) AS BIGINT) + 1] AS r1, lf[CAST(floor(h) AS BIGINT) + 1] AS f0, lf[CAST(ceil(h) AS BIGINT) + 1] AS f1 FROM o),
        th AS (SELECT video_id, CASE WHEN floor(h) = ceil(h) OR t0 = t1 THEN t0 ELSE (ceil(h) - h) * t0 + (h - floor(h)) * t1 END AS tt,
          CASE WHEN floor(h) = ceil(h) OR r0 = r1 THEN r0 ELSE (ceil(h) - h) * r0 + (h - floor(h)) * r1 END AS tr,
          CASE WHEN floor(h) = ceil(h) OR f0 = f1 THEN f0 ELSE (ceil(h) - h) * f0 + (h - floor(h)) * f1 END AS tf FROM ends),
        m AS (SELECT f.video_id, frame_index,
          match_count >= 10 AND step_proxy <= tt AND rotation_delta <= tr AND flow_mag <= tf AS go_in,
          match_count >= 10 AND step_proxy <= tt * 1.25 AND rotation_delta <= tr * 1.25 AND flow_mag <= tf * 1.25 AS stay
          FROM frames_v f JOIN th USING (video_id)),
        fold AS (SELECT video_id, frame_index, go_in AS s FROM m WHERE frame_index = 0
          UNION ALL SELECT m.video_id, m.frame_index, CASE WHEN fold.s THEN m.stay ELSE m.go_in END
          FROM fold JOIN m ON m.video_id = fold.video_id AND m.frame_index = fold.frame_index + 1)
        SELECT video_id, frame_index, s AS is_stationary FROM fold""",
        recursive=True,
    ),
)
def _stationary_hysteresis(spark, sf):
    df = V.frames(spark, sf)
    th = O.quantile_threshold(df, KEYS, ["step_proxy", "rotation_delta", "flow_mag"], quantile=0.6)
    return St.stationary_hysteresis(df, th, KEYS, **_STILL_OPTIONS)


_ISLANDS = """, flagged AS (SELECT *, flow_mag < 15 AS f FROM frames_v),
  isl AS (SELECT *, frame_index - row_number() OVER (PARTITION BY video_id, f ORDER BY frame_index) AS g FROM flagged),
  runs AS (SELECT video_id, g, min(frame_index) AS a, max(frame_index) AS b FROM isl WHERE f GROUP BY ALL)"""


def _flagged(spark, sf):
    return V.frames(spark, sf).withColumn("is_stationary", F.col("flow_mag") < 15)


@query(
    "drop_short_runs",
    "video_id:l frame_index:l is_stationary:b",
    with_views(
        _ISLANDS
        + """ SELECT video_id, frame_index, EXISTS (SELECT 1 FROM runs r WHERE r.video_id = flagged.video_id
          AND frame_index BETWEEN a AND b AND b - a + 1 >= 4) AS is_stationary FROM flagged"""
    ),
)
def _drop_short_runs(spark, sf):
    return St.drop_short_runs(_flagged(spark, sf), KEYS, fps=5.0, seconds=0.8)


@query(
    "boundary_grace",
    "video_id:l frame_index:l is_boundary:b",
    with_views(
        _ISLANDS
        + """ SELECT video_id, frame_index, EXISTS (SELECT 1 FROM runs r WHERE r.video_id = flagged.video_id
          AND (abs(frame_index - a) <= 2 OR abs(frame_index - b) <= 2)) AS is_boundary FROM flagged"""
    ),
)
def _boundary_grace(spark, sf):
    return St.boundary_grace(_flagged(spark, sf), KEYS)


@query(
    "stationary_ranges",
    "video_id:l first_frame:l last_frame:l",
    with_views(_ISLANDS + " SELECT video_id, a AS first_frame, b AS last_frame FROM runs"),
)
def _stationary_ranges(spark, sf):
    return St.stationary_ranges(_flagged(spark, sf), KEYS)


@query(
    "stationary_penalty",
    "video_id:l frame_index:l score:d is_stationary:b stationary_penalty_applied:b",
    with_views(
        _ISLANDS
        + """, m AS (SELECT *, f AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.video_id = flagged.video_id
          AND (abs(frame_index - a) <= 1 OR abs(frame_index - b) <= 1)) AND event_type <> 'error' AS hit FROM flagged)
        SELECT video_id, frame_index, CASE WHEN hit THEN score * 0.3 ELSE score END AS score, f AS is_stationary,
          hit AS stationary_penalty_applied FROM m WHERE laplacian_var >= 10"""
    ),
)
def _stationary_penalty(spark, sf):
    df = _flagged(spark, sf)
    flags = St.boundary_grace(df, KEYS, grace=1)
    cand = (
        df.filter("laplacian_var >= 10")
        .withColumn("is_forced", F.col("event_type") == "error")
        .select("video_id", "frame_index", "score", "is_forced")
    )
    return St.stationary_penalty(cand, flags, KEYS)


@query(
    "confidence_regions",
    "video_id:l band:s start_frame:l end_frame:l",
    with_views(
        """, b AS (SELECT *, CASE WHEN inlier_ratio < 0.45 THEN 'low' WHEN inlier_ratio < 0.6 THEN 'mid' ELSE 'high' END AS band FROM frames_v),
        g AS (SELECT *, frame_index - row_number() OVER (PARTITION BY video_id, band ORDER BY frame_index) AS g FROM b)
        SELECT video_id, band, min(frame_index) AS start_frame, max(frame_index) + 1 AS end_frame
        FROM g WHERE band <> 'high' GROUP BY video_id, band, g"""
    ),
)
def _confidence_regions(spark, sf):
    return St.confidence_regions(V.frames(spark, sf), KEYS, confidence="inlier_ratio", low=0.45, mid=0.6)


# Relative poses derived from the frames.
_T_DIR = ("sin(orb_keypoints)", "cos(laplacian_var)", "0.5")
_Q_REL = ("1.0", "(orb_keypoints - 50) / 200.0", "(laplacian_var - 80) / 900.0", "(rotation_delta - 12) / 50.0")


def _steps(spark, sf):
    return V.frames(spark, sf).select(
        "video_id",
        "frame_index",
        "vo_valid",
        "vo_attempted",
        "step_proxy",
        F.col("rotation_delta").alias("rotation_delta_deg"),
        F.array(*[F.expr(e).cast("double") for e in _T_DIR]).alias("t_dir"),
        F.array(*[F.expr(e).cast("double") for e in _Q_REL]).alias("q_rel"),
    )


@query(
    "median_step_norm",
    "video_id:l frame_index:l step_norm:d",
    with_views(
        """, m AS (SELECT video_id, coalesce(quantile_cont(step_proxy, 0.5) FILTER (vo_valid AND step_proxy > 0), 1) AS med
          FROM frames_v GROUP BY video_id)
        SELECT video_id, frame_index, CASE WHEN step_proxy > 0 THEN step_proxy / med ELSE 0 END AS step_norm
        FROM frames_v JOIN m USING (video_id)"""
    ),
)
def _median_step_norm(spark, sf):
    return T.step_norm(V.frames(spark, sf), KEYS)


@query(
    "trajectory_consistency",
    "video_id:l frame_index:l trajectory_consistency:d",
    with_views(
        f""", s AS (SELECT video_id, frame_index, vo_valid AND frame_index > 0 AS ok, least(step_proxy, 80) AS st, rotation_delta AS rot,
          {_T_DIR[0]} AS dx, {_T_DIR[1]} AS dy, {_T_DIR[2]} AS dz FROM frames_v),
        u AS (SELECT *, dx / n AS ux, dy / n AS uy, dz / n AS uz FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM s) q),
        l AS (SELECT *, sum(CAST(ok AS INT)) OVER w AS seen, coalesce(lag(ok) OVER w, false) AS pok, lag(st) OVER w AS pst,
          lag(rot) OVER w AS prot, lag(ux) OVER w AS px, lag(uy) OVER w AS py, lag(uz) OVER w AS pz
          FROM u WINDOW w AS (PARTITION BY video_id ORDER BY frame_index))
        SELECT video_id, frame_index, CASE WHEN frame_index = 0 THEN 0.5 WHEN NOT ok THEN 0 ELSE
          0.4 * least(seen / frame_index, 1) + 0.2 * CASE WHEN pok THEN (ux * px + uy * py + uz * pz + 1) * 0.5 ELSE 0.5 END
          + 0.2 * CASE WHEN pok THEN greatest(1 - abs(rot - prot) / 15, 0) ELSE 0.5 END
          + 0.2 * CASE WHEN pok AND st > 1e-12 AND pst > 1e-12 THEN greatest(1 - abs(ln(st) - ln(pst)), 0) ELSE 0.5 END
          END AS trajectory_consistency FROM l"""
    ),
)
def _trajectory_consistency(spark, sf):
    return T.trajectory_consistency(_steps(spark, sf), KEYS)


@query(
    "integrate_trajectory",
    "video_id:l frame_index:l tx:d ty:d tz:d q_abs:d step_norm:d",
    with_views(
        f""", m AS (SELECT video_id, coalesce(quantile_cont(step_proxy, 0.5) FILTER (vo_valid AND step_proxy > 0), 1) AS med
          FROM frames_v GROUP BY video_id),
        s AS (SELECT video_id, frame_index, vo_valid, CASE WHEN vo_valid THEN step_proxy / med ELSE 0 END AS sn,
          {_T_DIR[0]} AS dx, {_T_DIR[1]} AS dy, {_T_DIR[2]} AS dz, {_Q_REL[0]} AS a, {_Q_REL[1]} AS b, {_Q_REL[2]} AS c, {_Q_REL[3]} AS d
          FROM frames_v JOIN m USING (video_id)),
        n AS (SELECT video_id, frame_index, sn, CAST(sn * dx / tn AS DOUBLE) AS ex, CAST(sn * dy / tn AS DOUBLE) AS ey,
          CAST(sn * dz / tn AS DOUBLE) AS ez, CASE WHEN vo_valid THEN a / qn ELSE 1 END AS a, CASE WHEN vo_valid THEN b / qn ELSE 0 END AS b,
          CASE WHEN vo_valid THEN c / qn ELSE 0 END AS c, CASE WHEN vo_valid THEN d / qn ELSE 0 END AS d FROM (
          SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS tn, sqrt(a * a + b * b + c * c + d * d) AS qn FROM s) q),
        fold AS (SELECT video_id, CAST(-1 AS BIGINT) AS frame_index, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y,
          CAST(0 AS DOUBLE) AS z, CAST(0 AS DOUBLE) AS tx, CAST(0 AS DOUBLE) AS ty, CAST(0 AS DOUBLE) AS tz, CAST(0 AS DOUBLE) AS sn FROM m
          UNION ALL SELECT video_id, frame_index, w, x, y, z,
            tx + ex * (1 - 2 * (y * y + z * z)) + ey * 2 * (x * y - z * w) + ez * 2 * (x * z + y * w),
            ty + ex * 2 * (x * y + z * w) + ey * (1 - 2 * (x * x + z * z)) + ez * 2 * (y * z - x * w),
            tz + ex * 2 * (x * z - y * w) + ey * 2 * (y * z + x * w) + ez * (1 - 2 * (x * x + y * y)), sn FROM (
            SELECT n.video_id, n.frame_index, n.sn, n.ex, n.ey, n.ez, f.tx, f.ty, f.tz,
              f.w * n.a - f.x * n.b - f.y * n.c - f.z * n.d AS w, f.w * n.b + f.x * n.a + f.y * n.d - f.z * n.c AS x,
              f.w * n.c - f.x * n.d + f.y * n.a + f.z * n.b AS y, f.w * n.d + f.x * n.c - f.y * n.b + f.z * n.a AS z
            FROM fold f JOIN n ON n.video_id = f.video_id AND n.frame_index = f.frame_index + 1) q)
        SELECT video_id, frame_index, tx, ty, tz, abs(w) AS q_abs, sn AS step_norm FROM fold WHERE frame_index >= 0""",
        recursive=True,
    ),
)
def _integrate_trajectory(spark, sf):
    out = T.integrate_trajectory(_steps(spark, sf), KEYS, span=48)
    return out.select(
        "video_id",
        "frame_index",
        *[F.col("t_xyz")[i].alias(c) for i, c in enumerate(("tx", "ty", "tz"))],
        F.abs(F.col("q_wxyz")[0]).alias("q_abs"),
        "step_norm",
    )


@query(
    "fill_pose_forward",
    "video_id:l frame_index:l x:d y:d z:d",
    with_views(
        """, p AS (SELECT *, vo_valid AND orb_keypoints >= 70 AS ok FROM frames_v),
        h AS (SELECT video_id, frame_index, count(*) FILTER (ok) OVER (PARTITION BY video_id) AS n,
          coalesce(last_value(CASE WHEN ok THEN flow_mag END IGNORE NULLS) OVER w, 0) AS hx,
          coalesce(last_value(CASE WHEN ok THEN orb_keypoints END IGNORE NULLS) OVER w, 0) AS hy,
          coalesce(last_value(CASE WHEN ok THEN score END IGNORE NULLS) OVER w, 0) AS hz,
          first_value(CASE WHEN ok THEN flow_mag ELSE 0 END) OVER w AS ox,
          first_value(CASE WHEN ok THEN orb_keypoints ELSE 0 END) OVER w AS oy,
          first_value(CASE WHEN ok THEN score ELSE 0 END) OVER w AS oz
          FROM p WINDOW w AS (PARTITION BY video_id ORDER BY frame_index))
        SELECT video_id, frame_index, CASE WHEN n >= 2 THEN hx - ox END AS x, CASE WHEN n >= 2 THEN hy - oy END AS y,
          CASE WHEN n >= 2 THEN hz - oz END AS z FROM h"""
    ),
)
def _fill_pose_forward(spark, sf):
    df = V.frames(spark, sf).select(
        "video_id",
        "frame_index",
        (F.col("vo_valid") & (F.col("orb_keypoints") >= 70)).alias("vo_pose_valid"),
        F.array("flow_mag", "orb_keypoints", "score").alias("t_xyz"),
    )
    out = T.fill_pose_forward(df, KEYS)
    return out.select("video_id", "frame_index", *[F.col("path_xyz")[i].alias(c) for i, c in enumerate("xyz")])


@query(
    "pseudo_trajectory",
    "video_id:l frame_index:l x:d y:d z:d",
    with_views(
        """, c AS (SELECT video_id, quantile_cont(flow_mag, 0.95) AS cap FROM frames_v GROUP BY video_id),
        s AS (SELECT video_id, frame_index, CASE WHEN frame_index > 0 THEN least(flow_mag, cap) * 0.03 ELSE 0 END AS step,
          sum(CASE WHEN frame_index > 0 THEN radians(least(greatest(rotation_delta, 0), 30)) ELSE 0 END) OVER
            (PARTITION BY video_id ORDER BY frame_index) AS theta FROM frames_v JOIN c USING (video_id))
        SELECT video_id, frame_index, sum(step * cos(theta)) OVER w AS x, sum(step * sin(theta * 0.25) * 0.5) OVER w AS y,
          sum(step * sin(theta)) OVER w AS z FROM s WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)"""
    ),
)
def _pseudo_trajectory(spark, sf):
    return T.pseudo_trajectory(V.frames(spark, sf), KEYS)


# ---- selection -------------------------------------------------------------


@query(
    "nms",
    "video_id:l frame_index:l score:d",
    with_views(
        """, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) AS r FROM frames_v),
        fold AS (SELECT video_id, r, frame_index, score, true AS keep, [timestamp_s] AS kept FROM ranked WHERE r = 1
          UNION ALL SELECT video_id, r, frame_index, score, ok, CASE WHEN ok THEN list_append(kept, timestamp_s) ELSE kept END FROM (
            SELECT n.*, f.kept, len(list_filter(f.kept, lambda t: abs(t - n.timestamp_s) < 86400)) = 0 AS ok
            FROM fold f JOIN ranked n ON n.video_id = f.video_id AND n.r = f.r + 1) q)
        SELECT video_id, frame_index, score FROM fold WHERE keep""",
        recursive=True,
    ),
)
def _nms(spark, sf):
    return K.nms(written_table(V.frames(spark, sf), "frames"), KEYS, window=DAY)


@query(
    "fill_max_interval",
    "video_id:l frame_index:l",
    with_views(
        """, kf AS (SELECT * FROM frames_v WHERE orb_keypoints >= 92),
        gaps AS (SELECT video_id, frame_index AS last, timestamp_s AS last_t, lead(frame_index) OVER w AS f1, lead(timestamp_s) OVER w AS t1
          FROM kf WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)),
        fill AS (SELECT * FROM gaps UNION ALL SELECT video_id, pick.f, pick.t, f1, t1 FROM (
          SELECT l.video_id, l.last, l.f1, l.t1, arg_min({'f': c.frame_index, 't': c.timestamp_s},
            (abs(c.timestamp_s - (l.last_t + 129600)), -c.score, c.frame_index)) AS pick
          FROM fill l JOIN frames_v c ON c.video_id = l.video_id AND c.frame_index > l.last AND c.frame_index < l.f1
          WHERE l.t1 - l.last_t > 129600 GROUP BY ALL) q)
        SELECT DISTINCT video_id, last AS frame_index FROM fill""",
        recursive=True,
    ),
)
def _fill_max_interval(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "timestamp_s", "score", "orb_keypoints"), "frames")
    return K.fill_max_interval(df.filter("orb_keypoints >= 92"), df, KEYS, max_seconds=1.5 * DAY, span=48)


@query(
    "limit_top_k",
    "video_id:l frame_index:l score:d",
    with_views(
        """SELECT video_id, frame_index, score FROM rows_v
        QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) <= 7"""
    ),
)
def _limit_top_k(spark, sf):
    return K.limit_top_k(V.rows(spark, sf), KEYS, 7)


@query(
    "min_interval_select",
    "video_id:l frame_index:l",
    with_views(
        """, pass AS (SELECT video_id, frame_index FROM frames_v WHERE laplacian_var >= 25),
        sel AS (SELECT video_id, min(frame_index) AS frame_index FROM pass GROUP BY video_id
          UNION ALL SELECT s.video_id, min(p.frame_index) FROM sel s JOIN pass p
          ON p.video_id = s.video_id AND p.frame_index >= s.frame_index + 4 GROUP BY s.video_id)
        SELECT * FROM sel""",
        recursive=True,
    ),
)
def _min_interval_select(spark, sf):
    return K.min_interval_select(V.frames(spark, sf).filter("laplacian_var >= 25"), KEYS, 4, span=48)


def _similar(ref, rows):
    """Compares frames by brightness; stands in for an image comparison."""
    return {"ssim": 1 - np.abs(rows["brightness"] - ref["brightness"])}


def _matched(ref, rows):
    """The same, with match counts and failed and degenerate estimations."""
    rest = (rows["orb_keypoints"] + ref["orb_keypoints"]) % 7
    status = np.where(rest == 0, "failed", np.where(rest == 1, "degenerate", "ok"))
    return {**_similar(ref, rows), "match_count": np.minimum(rows["orb_keypoints"], ref["orb_keypoints"]), "status": status}


@query(
    "keyframe_chain",
    "video_id:l frame_index:l",
    with_views(
        """, pass AS (SELECT video_id, frame_index AS f, brightness AS b, lag(frame_index) OVER w AS pf, lag(brightness) OVER w AS pb
          FROM frames_v WHERE laplacian_var >= 10 WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)),
        chain AS (SELECT video_id, min(f) AS f FROM pass GROUP BY video_id
          UNION ALL SELECT c.video_id, min(p.f) FROM chain c JOIN pass i ON i.video_id = c.video_id AND i.f = c.f
          JOIN pass p ON p.video_id = c.video_id AND p.f >= c.f + 3
            AND (1 - abs(p.b - i.b) <= 0.4 OR abs(p.b - CASE WHEN p.pf >= c.f + 3 THEN p.pb ELSE i.b END) > 0.7)
          GROUP BY c.video_id)
        SELECT video_id, f AS frame_index FROM chain""",
        recursive=True,
    ),
)
def _keyframe_chain(spark, sf):
    rules = ChainRules(min_interval=3, ssim_threshold=0.4, exposure_threshold=0.7)
    return keyframe_scan(V.frames(spark, sf).filter("laplacian_var >= 10"), _similar, KEYS, columns=["brightness"], rules=rules, span=48)


@query(
    "keyframe_chain_rescue",
    "video_id:l frame_index:l ref_index:l ssim:d is_rescue_mode:b is_forced:b",
    with_views(
        """, pass AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS r, frame_index AS f, brightness AS b,
          orb_keypoints AS k FROM frames_v),
        fold AS (SELECT video_id, r, f, f AS kf, b AS kb, k AS kk, b AS pb, []::DOUBLE[] AS h, false AS rescue, true AS keep,
            NULL::BIGINT AS ref, NULL::DOUBLE AS ssim, false AS forced FROM pass WHERE r = 1
          UNION ALL SELECT video_id, r, f, CASE WHEN keep THEN f ELSE kf END, CASE WHEN keep THEN b ELSE kb END, CASE WHEN keep THEN k ELSE kk END,
            CASE WHEN tested THEN b ELSE pb END, h2, rescue2, keep, kf, s, failed OR jumped
          FROM (SELECT *, tested AND CASE WHEN failed THEN rescue2 ELSE s <= 0.4 OR jumped END AS keep
            FROM (SELECT *, CASE WHEN counted THEN len(h2) = 3 AND list_avg(h2) < 30 ELSE rescue END AS rescue2
              FROM (SELECT *, CASE WHEN counted THEN list_append(h, CASE WHEN failed THEN 0 ELSE least(k, kk) END)[-3:] ELSE h END AS h2
                FROM (SELECT *, tested AND sum <> 1 AS counted, sum = 0 AS failed
                  FROM (SELECT n.*, o.kf, o.kb, o.kk, o.pb, o.h, o.rescue, n.f - o.kf >= 3 AS tested, 1 - abs(n.b - o.kb) AS s,
                      abs(n.b - o.pb) > 0.7 AS jumped, (n.k + o.kk)::BIGINT % 7 AS sum
                    FROM fold o JOIN pass n ON n.video_id = o.video_id AND n.r = o.r + 1) q1) q2) q3) q4) q5)
        SELECT video_id, f AS frame_index, ref AS ref_index, ssim, rescue AS is_rescue_mode, forced AS is_forced FROM fold WHERE keep""",
        recursive=True,
    ),
)
def _keyframe_chain_rescue(spark, sf):
    rules = ChainRules(min_interval=3, ssim_threshold=0.4, exposure_threshold=0.7, rescue_window=3, rescue_threshold=30.0)
    return keyframe_scan(V.frames(spark, sf), _matched, KEYS, columns=["brightness", "orb_keypoints"], rules=rules, span=48)


@query(
    "gap_suggestions",
    "video_id:l left_frame:l right_frame:l best_frame:l",
    with_views(
        """, kf AS (SELECT video_id, frame_index AS a, lead(frame_index) OVER (PARTITION BY video_id ORDER BY frame_index) AS b
          FROM frames_v WHERE orb_keypoints >= 80)
        SELECT kf.video_id, a AS left_frame, b AS right_frame,
          arg_min(f.frame_index, (-(0.7 * score + 0.25 * exposure * (0.5 + 0.5 * inlier_ratio) - 0.05 * motion_blur), f.frame_index)) AS best_frame
        FROM kf JOIN frames_v f ON f.video_id = kf.video_id AND f.frame_index > a AND f.frame_index < b
        WHERE b - a > 6 GROUP BY ALL"""
    ),
)
def _gap_suggestions(spark, sf):
    df = V.frames(spark, sf).withColumn("is_keyframe", F.col("orb_keypoints") >= 80)
    df = df.withColumn("score", S.stage3_score("score", "exposure", "inlier_ratio", "motion_blur"))
    return K.gap_suggestions(df, KEYS, max_interval=4)


@query(
    "keyframe_order",
    "video_id:l frame_index:l by_frame:l by_score:l",
    with_views(
        """SELECT video_id, frame_index, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS by_frame,
        row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_index) - 1 AS by_score FROM rows_v"""
    ),
)
def _keyframe_order(spark, sf):
    df = V.rows(spark, sf).select("video_id", "frame_index", "score")
    out = K.keyframe_order(df, KEYS).withColumnRenamed("position", "by_frame")
    return K.keyframe_order(out, KEYS, by="score").withColumnRenamed("position", "by_score")


@query(
    "union_distinct",
    "video_id:l frame_index:l",
    with_views(
        """SELECT video_id, frame_index FROM rows_v WHERE score > 0.5
        UNION SELECT video_id, frame_index FROM rows_v WHERE vo_valid AND orb_keypoints > 60"""
    ),
)
def _union_distinct(spark, sf):
    df = V.rows(spark, sf)
    return K.union_distinct(df.filter("score > 0.5"), df.filter("vo_valid AND orb_keypoints > 60"), [*KEYS, "frame_index"])


@query(
    "missing_frames",
    "video_id:l frame_index:l",
    with_views(
        """SELECT video_id, frame_index FROM rows_v WHERE score > 0.5
        EXCEPT SELECT video_id, frame_index FROM rows_v WHERE vo_valid"""
    ),
)
def _missing_frames(spark, sf):
    df = V.rows(spark, sf).select(*KEYS, "frame_index", "score", "vo_valid")
    return K.missing_frames(df.filter("score > 0.5"), df.filter("vo_valid"), [*KEYS, "frame_index"])


# ---- nearest joins ---------------------------------------------------------


def _nearest_sql(left: str, right: str, cols: str, on: str = "frame_index") -> str:
    return f""", l AS ({left}), r AS ({right}),
      b AS (SELECT l.*, rb.{on} AS bk, ra.{on} AS ak FROM l
        ASOF LEFT JOIN r rb ON l.video_id = rb.video_id AND l.{on} >= rb.{on}
        ASOF LEFT JOIN r ra ON l.video_id = ra.video_id AND l.{on} <= ra.{on}),
      p AS (SELECT *, CASE WHEN ak IS NULL THEN bk WHEN bk IS NULL THEN ak WHEN {on} - bk <= ak - {on} THEN bk ELSE ak END AS k FROM b)
      {cols}"""


@query(
    "nearest_join",
    "video_id:l frame_index:l gap:l r_flow_mag:d",
    with_views(
        _nearest_sql(
            "SELECT * FROM frames_v WHERE event_type <> 'view'",
            "SELECT * FROM frames_v WHERE event_type = 'view'",
            """SELECT p.video_id, p.frame_index, abs(p.frame_index - k) AS gap, r.flow_mag AS r_flow_mag
            FROM p LEFT JOIN r ON r.video_id = p.video_id AND r.frame_index = k""",
        )
    ),
)
def _nearest_join(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "flow_mag", "event_type"), "frames")
    right = df.filter("event_type = 'view'").select(*KEYS, "frame_index", "flow_mag")
    return N.nearest_join(df.filter("event_type <> 'view'"), right, KEYS, "frame_index", dense=True)


@query(
    "inject_motion",
    "video_id:l frame_index:l rotation_delta:d match_count:d",
    with_views(
        _nearest_sql(
            "SELECT * FROM frames_v",
            "SELECT * FROM frames_v WHERE vo_attempted AND NOT vo_valid",
            """SELECT p.video_id, p.frame_index, coalesce(r.rotation_delta, p.rotation_delta) AS rotation_delta,
            coalesce(r.match_count, p.match_count) AS match_count
            FROM p LEFT JOIN r ON r.video_id = p.video_id AND r.frame_index = k""",
        )
    ),
)
def _inject_motion(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "rotation_delta", "match_count", "vo_attempted", "vo_valid"), "frames")
    motion = df.filter("vo_attempted AND NOT vo_valid").drop("vo_attempted", "vo_valid")
    return N.inject_motion(df, motion, KEYS)


@query(
    "align_imu",
    "video_id:l timestamp_s:d gap:d r_value:d",
    with_views(
        _nearest_sql(
            "SELECT * FROM frames_v WHERE event_type = 'view'",
            "SELECT * FROM frames_v WHERE event_type = 'purchase'",
            """SELECT p.video_id, p.timestamp_s, abs(p.timestamp_s - k) AS gap, r.laplacian_var AS r_value
            FROM p LEFT JOIN r ON r.video_id = p.video_id AND r.timestamp_s = k""",
            on="timestamp_s",
        )
    ),
)
def _align_imu(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "timestamp_s", "event_type", F.col("laplacian_var").alias("value")), "frames")
    right = df.filter("event_type = 'purchase'").select(*KEYS, "timestamp_s", "value")
    return N.nearest_join(df.filter("event_type = 'view'"), right, KEYS, "timestamp_s")


@query(
    "nearest_day",
    "cust:l day:l gap:l price:d",
    """WITH l AS (SELECT DISTINCT o_custkey AS cust, CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS day
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
      r AS (SELECT o_custkey AS cust, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS day, arg_min(o_totalprice, o_orderkey) AS price
        FROM orders GROUP BY ALL),
      b AS (SELECT l.*, rb.day AS bk, ra.day AS ak FROM l ASOF LEFT JOIN r rb ON l.cust = rb.cust AND l.day >= rb.day
        ASOF LEFT JOIN r ra ON l.cust = ra.cust AND l.day <= ra.day),
      p AS (SELECT *, CASE WHEN ak IS NULL THEN bk WHEN bk IS NULL THEN ak WHEN day - bk <= ak - day THEN bk ELSE ak END AS k FROM b)
    SELECT p.cust, p.day, abs(p.day - k) AS gap, r.price FROM p LEFT JOIN r ON r.cust = p.cust AND r.day = k""",
)
def _nearest_day(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("bigint")
    left = (
        V.table(spark, sf, "lineitem")
        .select("l_orderkey", "l_shipdate")
        .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("cust"), day("l_shipdate").alias("day"))
        .distinct()
    )
    right = o.groupBy(F.col("o_custkey").alias("cust"), day("o_orderdate").alias("day")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("price")
    )
    out = N.nearest_join(left, right, ["cust"], "day", dense=True)
    return out.select("cust", "day", "gap", F.col("r_price").alias("price"))


@query(
    "nearest_pose",
    "video_id:l frame_index:l pose_x:d vo_pose_valid:b",
    with_views(
        _nearest_sql(
            "SELECT * FROM frames_v",
            "SELECT * FROM frames_v WHERE vo_valid",
            """SELECT p.video_id, p.frame_index, r.flow_mag AS pose_x, coalesce(k = p.frame_index, false) AS vo_pose_valid
            FROM p LEFT JOIN r ON r.video_id = p.video_id AND r.frame_index = k""",
        )
    ),
)
def _nearest_pose(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "flow_mag", "vo_valid"), "frames")
    poses = df.filter("vo_valid").select(*KEYS, "frame_index", F.col("flow_mag").alias("x"))
    return N.nearest_pose(df, poses, KEYS)


@query(
    "nearest_within",
    "video_id:l frame_index:l mask:l",
    with_views(
        _nearest_sql(
            "SELECT * FROM frames_v",
            "SELECT * FROM frames_v WHERE orb_keypoints > 75",
            """SELECT p.video_id, p.frame_index, CASE WHEN abs(p.frame_index - k) <= 2 THEN k END AS mask FROM p""",
        )
    ),
)
def _nearest_within(spark, sf):
    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "orb_keypoints"), "frames")
    masks = df.filter("orb_keypoints > 75").select(*KEYS, "frame_index")
    out = N.nearest_within(df, masks, KEYS, "frame_index", ttl=2, dense=True)
    return out.withColumn("mask", F.col("r_frame_index"))


@query(
    "frame_score_merge",
    "video_id:l frame_index:l laplacian_var:d flow_mag:d vo_confidence:d is_keyframe:b vo_status_reason:s",
    with_views(
        """SELECT f.video_id, f.frame_index, f.laplacian_var, coalesce(m.flow_mag, 0) AS flow_mag,
        coalesce(v.inlier_ratio, 0) AS vo_confidence, k.frame_index IS NOT NULL AS is_keyframe,
        coalesce(v.event_type, 'not_evaluated') AS vo_status_reason FROM rows_v f
        LEFT JOIN (SELECT * FROM rows_v WHERE orb_keypoints > 30) m ON m.video_id = f.video_id AND m.frame_index = f.frame_index
        LEFT JOIN (SELECT * FROM rows_v WHERE vo_valid) v ON v.video_id = f.video_id AND v.frame_index = f.frame_index
        LEFT JOIN (SELECT * FROM rows_v WHERE score > 0.5) k ON k.video_id = f.video_id AND k.frame_index = f.frame_index"""
    ),
)
def _frame_score_merge(spark, sf):
    df = V.rows(spark, sf)
    frame = [*KEYS, "frame_index"]
    motion = df.filter("orb_keypoints > 30").select(*frame, "flow_mag")
    vo = df.filter("vo_valid").select(*frame, F.col("inlier_ratio").alias("vo_confidence"), F.col("event_type").alias("vo_status_reason"))
    merged = N.frame_score_merge(
        df.select(*frame, "laplacian_var"),
        frame,
        [(motion, {"flow_mag": 0.0}), (vo, {"vo_confidence": 0.0, "vo_status_reason": "not_evaluated"})],
    )
    return N.mark_keyframes(merged, df.filter("score > 0.5"), frame)


@query(
    "mark_keyframes",
    "video_id:l frame_index:l is_keyframe:b",
    with_views("SELECT video_id, frame_index, score > 0.45 AND vo_valid AS is_keyframe FROM rows_v"),
)
def _mark_keyframes(spark, sf):
    df = V.rows(spark, sf).select(*KEYS, "frame_index", "score", "vo_valid")
    return N.mark_keyframes(df, df.filter("score > 0.45 AND vo_valid"), [*KEYS, "frame_index"])


@query(
    "consecutive_pairs",
    "video_id:l ref_index:l frame_index:l overlap:d",
    with_views(
        """, d AS (SELECT video_id, frame_index, cos(radians(pitch)) * cos(radians(yaw)) AS x, sin(radians(pitch)) AS y,
          cos(radians(pitch)) * sin(radians(yaw)) AS z FROM frames_v)
        SELECT a.video_id, a.frame_index AS ref_index, b.frame_index,
          greatest(1 - acos(least(greatest(a.x * b.x + a.y * b.y + a.z * b.z, -1), 1)) / radians(90), 0) AS overlap
        FROM d a JOIN d b ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1"""
    ),
)
def _consecutive_pairs(spark, sf):
    from reelframe.functions.pose import view_overlap

    df = written_table(V.frames(spark, sf).select(*KEYS, "frame_index", "yaw", "pitch"), "frames")
    pairs = P.consecutive_pairs(df, KEYS)
    ref = df.select(*KEYS, F.col("frame_index").alias("ref_index"), F.col("yaw").alias("yaw1"), F.col("pitch").alias("pitch1"))
    out = pairs.join(ref, [*KEYS, "ref_index"]).join(df, [*KEYS, "frame_index"])
    return out.withColumn("overlap", view_overlap("yaw1", "pitch1", "yaw", "pitch"))


@query(
    "band_pairs",
    "video_id:l ref_index:l frame_index:l change:d",
    with_views(
        ", l AS (SELECT video_id, frame_index, flow_mag, "
        + ", ".join(f"lead(flow_mag, {k}) OVER w AS f{k}, lead(frame_index, {k}) OVER w AS i{k}" for k in range(2, 7))
        + " FROM scan_v WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)) "
        + " UNION ALL ".join(
            f"SELECT video_id, frame_index AS ref_index, i{k} AS frame_index, abs(flow_mag - f{k}) AS change FROM l WHERE i{k} IS NOT NULL" for k in range(2, 7)
        )
    ),
)
def _band_pairs(spark, sf):
    df = written_table(V.scan(spark, sf).select(*KEYS, "frame_index", "flow_mag"), "frames")
    pairs = P.band_pairs(df, KEYS, nearest=2, furthest=6, ref_columns={"flow_mag": "ref_flow"})
    return pairs.withColumn("change", F.abs(F.col("flow_mag") - F.col("ref_flow")))
