"""Queries over sources, sinks, inertial samples, run state and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import QUERIES, query
from reelframe.catalogue.quality import gate_cte
from reelframe.catalogue.sequences import _steps
from reelframe.catalogue.views import with_views
from reelframe.operators import imu as I
from reelframe.operators import quality as O
from reelframe.operators.trajectory import median_step
from reelframe.plans.blocks import assign_index, attach
from reelframe.session import scratch_root, written_table
from reelframe.sources import frames as Fr
from reelframe.sources import logs as L
from reelframe.sources import sinks as Si
from reelframe.sources import stages as St
from reelframe.streaming import jobs as J

KEYS = ["video_id"]


# ---- scans -----------------------------------------------------------------


@query(
    "sample_slice",
    "video_id:l frame_index:l flow_mag:d",
    with_views("SELECT * FROM rows_v WHERE frame_index >= 20 AND (frame_index - 20) % 7 = 0"),
)
def _sample_slice(spark, sf):
    return Fr.sample_frames(V.rows(spark, sf), start=20, step=7)


@query(
    "frame_at_time",
    "video_id:l frame_index:l seconds:d flow_mag:d",
    with_views(
        """, t AS (SELECT s_suppkey AS video_id, abs(s_acctbal) / 500 AS seconds FROM supplier)
        SELECT f.video_id, f.frame_index, t.seconds, f.flow_mag FROM t JOIN scan_v f ON f.video_id = t.video_id
        AND f.frame_index = CAST(trunc(t.seconds * 29.97) AS BIGINT)"""
    ),
)
def _frame_at_time(spark, sf):
    times = V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("video_id"), (F.abs("s_acctbal") / 500).alias("seconds"))
    return Fr.frame_at_time(times, V.scan(spark, sf), KEYS, F.lit(29.97))


@query(
    "frames_by_index",
    "video_id:l frame_index:l flow_mag:d",
    with_views("SELECT * FROM rows_v WHERE frame_index IN (SELECT o_orderkey * 3 FROM orders WHERE o_orderstatus = 'F')"),
)
def _frames_by_index(spark, sf):
    wanted = V.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select((F.col("o_orderkey") * 3).alias("frame_index"))
    return Fr.frames_by_index(V.rows(spark, sf), wanted, ["frame_index"])


_PAIR_SQL = """, p AS (SELECT video_id, frame_index // 2 AS frame_index,
    max(laplacian_var) FILTER (frame_index % 2 = 0) AS a_laplacian_var, max(laplacian_var) FILTER (frame_index % 2 = 1) AS b_laplacian_var,
    max(exposure) FILTER (frame_index % 2 = 0) AS a_exposure, max(exposure) FILTER (frame_index % 2 = 1) AS b_exposure,
    max(ssim) FILTER (frame_index % 2 = 0) AS a_quality, max(ssim) FILTER (frame_index % 2 = 1) AS b_quality,
    max(orb_keypoints) FILTER (frame_index % 2 = 0) / 1000.0 AS a_blur, max(orb_keypoints) FILTER (frame_index % 2 = 1) / 1000.0 AS b_blur
    FROM scan_v GROUP BY video_id, frame_index // 2 HAVING count(*) = 2)"""


def _pairs(spark, sf):
    df = V.scan(spark, sf).withColumns(
        {
            "lens": F.when(F.col("frame_index") % 2 == 0, "a").otherwise("b"),
            "frame_index": F.floor(F.col("frame_index") / 2),
            "quality": F.col("ssim"),
            "sharpness": F.col("laplacian_var"),
            "motion_blur": F.col("orb_keypoints") / 1000.0,
        }
    )
    df = written_table(df, "lenses")
    return Fr.paired_scan(df, [*KEYS, "frame_index"], ["laplacian_var", "sharpness", "exposure", "quality", "motion_blur"])


@query("paired_scan", "video_id:l frame_index:l a_laplacian_var:d b_laplacian_var:d", with_views(_PAIR_SQL + " SELECT * FROM p"))
def _paired_scan(spark, sf):
    return _pairs(spark, sf)


@query(
    "pair_gate",
    "video_id:l frame_index:l quality:d exposure:d is_pass:b drop_reason:s",
    with_views(
        _PAIR_SQL
        + """, g AS (SELECT *, least(a_quality, b_quality) AS quality, least(a_exposure, b_exposure) AS exposure FROM p),
        r AS (SELECT *, CASE WHEN a_laplacian_var < 15000 OR b_laplacian_var < 15000 THEN 'abs_laplacian_guard'
          WHEN quality < 0.95 THEN 'quality_below_threshold' ELSE 'pass' END AS drop_reason FROM g)
        SELECT *, drop_reason = 'pass' AS is_pass FROM r"""
    ),
)
def _pair_gate(spark, sf):
    return O.pair_gate(_pairs(spark, sf), threshold=0.95, abs_min=15000.0)


@query(
    "legacy_pair_gate",
    "video_id:l frame_index:l quality:d sharpness:d motion_blur:d is_pass:b",
    with_views(
        _PAIR_SQL
        + """, q AS (SELECT *, (least(a_laplacian_var / 100, 1) + least(a_exposure / 0.35, 1) + greatest(1 - a_blur / 0.3, 0)) / 3 AS qa,
          (least(b_laplacian_var / 100, 1) + least(b_exposure / 0.35, 1) + greatest(1 - b_blur / 0.3, 0)) / 3 AS qb FROM p)
        SELECT *, least(qa, qb) AS quality, least(a_laplacian_var, b_laplacian_var) AS sharpness, greatest(a_blur, b_blur) AS motion_blur,
          a_laplacian_var >= 100 AND b_laplacian_var >= 100 AND a_blur <= 0.3 AND b_blur <= 0.3 AND a_exposure >= 0.35 AND b_exposure >= 0.35 AS is_pass FROM q"""
    ),
)
def _legacy_pair_gate(spark, sf):
    return O.legacy_pair_gate(_pairs(spark, sf))


@query(
    "pair_consistency_report",
    "video_id:l fps_differs:b count_differs:b size_differs:b frame_count:l",
    """WITH v AS (SELECT o_custkey AS video_id, CASE o_orderstatus WHEN 'F' THEN 'a' ELSE 'b' END AS s, count(*) AS n, 24 + max(o_orderkey % 3) * 0.0007 AS fps, 100 * (1 + min(o_orderkey) % 2) AS w
        FROM orders GROUP BY ALL)
    SELECT a.video_id, abs(a.fps - b.fps) > 1e-3 AS fps_differs, a.n <> b.n AS count_differs, a.w <> b.w AS size_differs, least(a.n, b.n) AS frame_count
    FROM v a JOIN v b USING (video_id) WHERE a.s = 'a' AND b.s = 'b'""",
)
def _pair_consistency(spark, sf):
    v = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("lens")).agg(
        F.count(F.lit(1)).alias("frame_count"),
        (24 + F.max(F.col("o_orderkey") % 3) * 0.0007).alias("fps"),
        (100 * (1 + F.min("o_orderkey") % 2)).alias("width"),
        F.lit(50).alias("height"),
    )
    return Fr.pair_consistency_report(v, KEYS)


def _dump(spark, sf, gyro: str):
    """A dump per user: a stamp, three accelerations, and a gyro set for some events."""
    e = V.table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("k", F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int"))
    line = lambda tag, v: F.concat(F.lit(f"[Protobuf]      {tag} : "), v.cast("string"))
    items = F.array_compact(
        F.array(
            line("TimeStamp", F.col("event_id") / 8.0),
            F.lit("[Protobuf]      Unknown : x"),
            line("AccelerometerX", F.col("value")),
            line("AccelerometerY", F.col("k")),
            F.when(F.col("k") != 13, line("AccelerometerZ", F.col("value") + 1)).otherwise("[Protobuf]  AccelerometerZ : n/a"),
            *[F.when(F.expr(gyro), line(f"AngularVelocity{a}", F.col("k") + i)) for i, a in enumerate("XYZ")],
        )
    )
    e = e.select(F.col("user_id").alias("source"), "us", "event_id", F.posexplode(items).alias("j", "text"))
    return assign_index(e, ["source"], ["us", "event_id", "j"], "line_no").select("source", "line_no", "text")


_DUMP_SQL = """WITH e AS (SELECT user_id AS source, event_id, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) AS k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"""
_IMU_COLS = "source:l sample:l ts:d t0:d ax:d ay:d az:d gx:d gz:d"


def _imu_columns(df):
    names = [("TimeStamp", "ts"), ("TimeStamp0", "t0"), ("AccelerometerX", "ax"), ("AccelerometerY", "ay"), ("AccelerometerZ", "az")]
    names += [("AngularVelocityX", "gx"), ("AngularVelocityZ", "gz")]
    return df.select("source", "sample", *[F.col(a).alias(b) for a, b in names])


@query(
    "imu_scan_by_position",
    _IMU_COLS,
    _DUMP_SQL
    + """, z AS (SELECT source, value + 1 AS az, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS m FROM e WHERE k <> 13),
      g AS (SELECT source, k AS gx, k + 2 AS gz, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS m FROM e WHERE k % 3 = 0)
    SELECT e.source, e.n AS sample, event_id / 8.0 AS ts, event_id / 8.0 - min(event_id / 8.0) OVER (PARTITION BY e.source) AS t0,
      value AS ax, k AS ay, az, gx, gz FROM e JOIN z ON z.source = e.source AND z.m = e.n LEFT JOIN g ON g.source = e.source AND g.m = e.n""",
)
def _imu_by_position(spark, sf):
    return _imu_columns(L.imu_scan_by_position(_dump(spark, sf, "k % 3 = 0")))


@query(
    "imu_scan_by_block",
    _IMU_COLS,
    _DUMP_SQL
    + """, b AS (SELECT *, event_id / 8.0 AS ts FROM e WHERE k <> 13)
    SELECT source, row_number() OVER w - 1 AS sample, ts, ts - first_value(ts) OVER w AS t0, value AS ax, k AS ay, value + 1 AS az,
      CASE WHEN k % 3 = 0 THEN k END AS gx, CASE WHEN k % 3 = 0 THEN k + 2 END AS gz FROM b WINDOW w AS (PARTITION BY source ORDER BY n)""",
)
def _imu_by_block(spark, sf):
    return _imu_columns(L.imu_scan_by_block(_dump(spark, sf, "k % 3 = 0")))


@query(
    "frame_pts_scan",
    "source:l frame_idx:l pts_sec:d numbered:b",
    """WITH l AS (SELECT o_custkey AS source, o_orderkey AS n, o_totalprice / 100 AS t, o_orderstatus AS s FROM orders)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS frame_idx, t AS pts_sec, false AS numbered FROM l WHERE s <> 'P'
    UNION ALL SELECT source, n * 2, t, true FROM l WHERE s <> 'P'""",
)
def _frame_pts_scan(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("line_no"), "o_totalprice", "o_orderstatus")
    t = F.when(F.col("o_orderstatus") == "P", "bad").otherwise((F.col("o_totalprice") / 100).cast("string"))
    one = o.select("source", "line_no", F.concat(F.lit(" "), t).alias("text"))
    two = o.select("source", "line_no", F.concat_ws(",", (F.col("line_no") * 2).cast("string"), t).alias("text"))
    a = L.frame_pts_scan(one).withColumn("numbered", F.lit(False))
    return a.unionByName(L.frame_pts_scan(two, columns=2).withColumn("numbered", F.lit(True)))


@query(
    "frame_metrics_scan",
    "source:l frame_idx:l tx:d qw:d is_keyframe:b flow:d keyframe_flag:d extra:d",
    """SELECT event_id AS source, event_id * 2 AS frame_idx, CASE WHEN event_type = 'view' THEN value ELSE event_id * 2 END AS tx,
      CASE WHEN event_type = 'click' THEN 0.5 ELSE 1 END AS qw, event_type IN ('signup', 'error') AS is_keyframe,
      CASE WHEN event_type = 'purchase' THEN 0 ELSE value END AS flow, CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END AS keyframe_flag,
      CASE WHEN event_type = 'click' THEN 3 END AS extra FROM events""",
)
def _frame_metrics_scan(spark, sf):
    e = V.table(spark, sf, "events")
    t, v = F.col("event_type"), F.col("value").cast("string")
    pair = lambda cond, k, val: F.when(cond, F.create_map(F.lit(k), val)).otherwise(F.create_map().cast("map<string,string>"))
    record = F.map_concat(
        F.create_map(F.lit("frame_index"), (F.col("event_id") * 2).cast("string")),
        F.create_map(F.lit("metrics"), F.concat(F.lit('{"flow_mag": '), v, F.lit(', "x": "?"}'))),
        pair(t == "view", "t_xyz", F.concat(F.lit("["), v, F.lit(",0,0]"))),
        pair(t == "click", "qw", F.lit("0.5")),
        pair(t == "click", "m_extra", F.lit("3")),
        pair(t == "signup", "is_keyframe", F.lit(" Yes")),
        pair(t == "error", "keyframe_flag", F.lit("1.0")),
        pair(t == "purchase", "flow_mag", F.lit("none")),
    )
    out = L.frame_metrics_scan(e.select(F.col("event_id").alias("source"), F.lit(0).alias("position"), record.alias("record")))
    m = lambda k: F.element_at("metrics", k)
    return out.select(
        "source",
        "frame_idx",
        F.col("t_xyz")[0].alias("tx"),
        F.col("q_wxyz")[0].alias("qw"),
        "is_keyframe",
        m("flow_mag").alias("flow"),
        m("keyframe_flag").alias("keyframe_flag"),
        m("extra").alias("extra"),
    )


# ---- inertial samples ------------------------------------------------------

_ACCEL = {"ax": "value / 50", "ay": "k / 10.0", "az": "9.8 + value / 400"}
_IMU_SQL = """, s AS (SELECT video_id, frame_index AS n, timestamp_s / 3600 AS t, laplacian_var / 50 AS ax, orb_keypoints / 10.0 AS ay,
  9.8 + laplacian_var / 400 AS az FROM frames_v),
  g AS (SELECT *, sum(ax) OVER w / 20 AS gx, sum(ay) OVER w / 20 AS gy, sum(az) OVER w / 20 AS gz FROM s
    WINDOW w AS (PARTITION BY video_id ORDER BY n ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)),
  d AS (SELECT *, ax - gx AS dx, ay - gy AS dy, az - gz AS dz FROM g)"""


def _imu(spark, sf):
    return V.frames(spark, sf).select(
        "video_id",
        F.col("frame_index").alias("n"),
        (F.col("timestamp_s") / 3600).alias("t"),
        F.expr("laplacian_var / 50").alias("ax"),
        F.expr("orb_keypoints / 10.0D").alias("ay"),
        F.expr("9.8D + laplacian_var / 400").alias("az"),
    )


def _dynamic(spark, sf):
    return I.gravity_moving_average(_imu(spark, sf), KEYS, "n", window=20, span=64)


@query("gravity_moving_average", "video_id:l n:l gx:d gy:d gz:d dx:d dz:d", with_views(_IMU_SQL + " SELECT * FROM d"))
def _gravity(spark, sf):
    return _dynamic(spark, sf)


_VELOCITY_SQL = _IMU_SQL + """, a AS (SELECT *, coalesce((dx + lag(dx) OVER w) * 0.5 * (t - lag(t) OVER w), 0) AS ix,
    coalesce((dy + lag(dy) OVER w) * 0.5 * (t - lag(t) OVER w), 0) AS iy, coalesce((dz + lag(dz) OVER w) * 0.5 * (t - lag(t) OVER w), 0) AS iz
    FROM d WINDOW w AS (PARTITION BY video_id ORDER BY n)),
  v AS (SELECT *, sum(ix) OVER w AS vx, sum(iy) OVER w AS vy, sum(iz) OVER w AS vz FROM a WINDOW w AS (PARTITION BY video_id ORDER BY n))"""


@query("integrate_trapezoid", "video_id:l n:l vx:d vy:d vz:d", with_views(_VELOCITY_SQL + " SELECT * FROM v"))
def _trapezoid(spark, sf):
    return I.integrate_trapezoid(_dynamic(spark, sf), KEYS, "n", time="t", inputs=["dx", "dy", "dz"], outputs=["vx", "vy", "vz"])


@query(
    "remove_linear_trend",
    "video_id:l n:l vx:d vz:d",
    with_views(
        _VELOCITY_SQL
        + """, f AS (SELECT video_id, coalesce(regr_slope(vx, n), 0) AS mx, coalesce(regr_intercept(vx, n), avg(vx)) AS bx,
          coalesce(regr_slope(vz, n), 0) AS mz, coalesce(regr_intercept(vz, n), avg(vz)) AS bz FROM v GROUP BY video_id)
        SELECT video_id, n, vx - (mx * n + bx) AS vx, vz - (mz * n + bz) AS vz FROM v JOIN f USING (video_id)"""
    ),
)
def _trend(spark, sf):
    v = I.integrate_trapezoid(_dynamic(spark, sf), KEYS, "n", time="t", inputs=["dx", "dy", "dz"], outputs=["vx", "vy", "vz"])
    return I.remove_linear_trend(written_table(v, "velocity"), KEYS, "n", ["vx", "vz"])


@query(
    "imu_summary",
    "video_id:l samples:l sample_rate:d gravity:d dynamic_rms:d path_length:d distance:d",
    with_views(
        _VELOCITY_SQL
        + """, h AS (SELECT *, sqrt((vx - lag(vx) OVER w) ** 2 + (vy - lag(vy) OVER w) ** 2 + (vz - lag(vz) OVER w) ** 2) AS hop
          FROM v WINDOW w AS (PARTITION BY video_id ORDER BY n))
        SELECT video_id, count(*) AS samples, CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) ELSE 0 END AS sample_rate,
          avg(sqrt(ax * ax + ay * ay + az * az)) AS gravity, sqrt(avg(dx * dx + dy * dy + dz * dz)) AS dynamic_rms, coalesce(sum(hop), 0) AS path_length,
          sqrt((arg_max(vx, n) - arg_min(vx, n)) ** 2 + (arg_max(vy, n) - arg_min(vy, n)) ** 2 + (arg_max(vz, n) - arg_min(vz, n)) ** 2) AS distance
        FROM h GROUP BY video_id"""
    ),
)
def _imu_summary(spark, sf):
    v = I.integrate_trapezoid(_dynamic(spark, sf), KEYS, "n", time="t", inputs=["dx", "dy", "dz"], outputs=["px", "py", "pz"])
    return I.imu_summary(written_table(v, "velocity"), KEYS, "n")


# ---- sinks -----------------------------------------------------------------


@query(
    "quality_metrics_sink",
    "video_id:l frame_index:l quality:d is_pass:b raw_metrics:s norm_metrics:s",
    with_views(
        """SELECT video_id, frame_index, score AS quality, score > 0.4 AS is_pass,
        '{"contrast":' || CAST(orb_keypoints AS INT) || ',"roi_pixel_count":' || (CAST(orb_keypoints AS INT) + 2) || '}' AS raw_metrics,
        '{}' AS norm_metrics FROM rows_v"""
    ),
)
def _quality_metrics_sink(spark, sf):
    k = F.col("orb_keypoints").cast("int")
    df = V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        F.col("score").alias("quality"),
        (F.col("score") > 0.4).alias("is_pass"),
        F.create_map(F.lit("roi_pixel_count"), k + 2, F.lit("contrast"), k).alias("raw_metrics"),
    )
    return Si.quality_metrics_rows(df)


@query(
    "vo_trajectory_sink",
    "video_id:l frame_idx:l t_x:d t_z:d q_w:d vo_valid:d vo_inlier_ratio:d vo_confidence:d",
    with_views(
        """SELECT video_id, frame_index AS frame_idx, CASE WHEN vo_valid THEN flow_mag END AS t_x, CASE WHEN vo_valid THEN score END AS t_z,
        CASE WHEN vo_attempted THEN 1 END AS q_w, CAST(vo_valid AS INT) AS vo_valid, CASE WHEN orb_keypoints > 50 THEN inlier_ratio ELSE 0 END AS vo_inlier_ratio,
        0 AS vo_confidence FROM rows_v"""
    ),
)
def _vo_trajectory_sink(spark, sf):
    known = F.col("orb_keypoints") > 50
    df = V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        F.when(F.col("vo_valid"), F.array("flow_mag", "yaw", "score")).otherwise(F.array("flow_mag")).alias("t_xyz"),
        F.when(F.col("vo_attempted"), F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0)])).alias("q_wxyz"),
        F.map_filter(
            F.create_map(F.lit("vo_valid"), F.col("vo_valid").cast("double"), F.lit("vo_inlier_ratio"), F.when(known, F.col("inlier_ratio"))),
            lambda _, v: v.isNotNull(),
        ).alias("metrics"),
    )
    return Si.vo_trajectory_rows(df)


@query(
    "keyframe_metadata_sink",
    "video_id:l line_no:l text:s",
    with_views(
        """, k AS (SELECT video_id, frame_index, CAST(orb_keypoints AS INT) / 8.0 AS sc, max(frame_index) OVER (PARTITION BY video_id) AS m FROM rows_v WHERE score > 0.5),
        n AS (SELECT video_id, count(*) AS n FROM k GROUP BY video_id), v AS (SELECT DISTINCT video_id FROM rows_v)
        SELECT video_id, frame_index AS line_no, '{"frame_index":' || frame_index || ',"timestamp":' || (frame_index / 8.0) || ',"combined_score":' || sc ||
          ',"quality_scores":{"q":' || sc || '}}' || CASE WHEN frame_index < m THEN ',' ELSE '' END AS text FROM k
        UNION ALL SELECT video_id, -1, '{"rig":"monocular","keyframe_count":' || coalesce(n, 0) || ',"keyframes":[' FROM v LEFT JOIN n USING (video_id)
        UNION ALL SELECT video_id, 4611686018427387904, ']}' FROM v"""
    ),
)
def _keyframe_metadata(spark, sf):
    df = V.rows(spark, sf)
    sc = F.col("orb_keypoints").cast("int") / 8.0
    kf = df.filter("score > 0.5").select(
        "video_id",
        "frame_index",
        (F.col("frame_index") / 8.0).alias("timestamp"),
        sc.alias("combined_score"),
        F.create_map(F.lit("q"), sc).alias("quality_scores"),
    )
    head = df.select("video_id").distinct().withColumn("header", F.lit('{"rig":"monocular"}'))
    return Si.keyframe_metadata_lines(head, kf)


def _colmap_images(spark, sf):
    return V.rows(spark, sf).filter("score > 0.5").select(
        "video_id",
        "frame_index",
        F.when(F.col("event_type") == "view", "L").when(F.col("event_type") == "click", "R").otherwise("images").alias("folder"),
        F.format_string("keyframe_%06d.png", "frame_index").alias("file_name"),
        F.lit(1920).alias("width"),
        F.lit(960).alias("height"),
    )


@query(
    "colmap_images",
    "video_id:l text:s",
    with_views(
        """SELECT video_id, CASE event_type WHEN 'view' THEN 'L__' WHEN 'click' THEN 'R__' ELSE '' END || printf('keyframe_%06d.png', frame_index)
        || CASE event_type WHEN 'view' THEN ' 2' WHEN 'click' THEN ' 3' ELSE ' 1' END AS text FROM rows_v WHERE score > 0.5"""
    ),
)
def _colmap_image_lines(spark, sf):
    return Si.colmap_images(_colmap_images(spark, sf))


@query(
    "colmap_cameras",
    "video_id:l camera_id:l text:s",
    with_views(
        """, c AS (SELECT DISTINCT video_id, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 1 END AS camera_id FROM rows_v WHERE score > 0.5)
        SELECT video_id, camera_id, CASE WHEN camera_id = 2 THEN printf('2 PINHOLE 1920 960 %.6f %.6f 950.500000 480.250000', 700.0 + video_id, 701.5 + video_id)
          ELSE camera_id || ' PINHOLE 1920 960 960.000000 960.000000 960.000000 480.000000' END AS text FROM c"""
    ),
)
def _colmap_camera_lines(spark, sf):
    v = V.rows(spark, sf).select("video_id").distinct()
    z, x = F.lit(0.0), F.col("video_id").cast("double")
    k = F.array(x + 700.0, z, F.lit(950.5), z, x + 701.5, F.lit(480.25), z, z, F.lit(1.0))
    return Si.colmap_cameras(_colmap_images(spark, sf), v.select("video_id", F.lit(2).alias("camera_id"), k.alias("k")))


@query(
    "export_manifest",
    "video_id:l frame_index:l path:s mask:s",
    with_views(
        """, k AS (SELECT video_id, frame_index, printf('keyframe_%06d', frame_index) AS b FROM rows_v WHERE score > 0.55),
        p AS (SELECT video_id, frame_index, 'images/L/' || b || '_L.jpg' AS path FROM k UNION ALL SELECT video_id, frame_index, 'images/R/' || b || '_R.jpg' FROM k
          UNION ALL SELECT video_id, frame_index, 'cubemap/front/' || b || '_front.jpg' FROM k
          UNION ALL SELECT video_id, frame_index, 'perspective/y+90_p-30/' || b || '_y+90_p-30.jpg' FROM k
          UNION ALL SELECT video_id, frame_index, 'images/L_up/' || b || '_L_up.jpg' FROM k UNION ALL SELECT video_id, frame_index, 'images/R_up/' || b || '_R_up.jpg' FROM k)
        SELECT video_id, frame_index, path, 'masks/' || replace(regexp_replace(regexp_replace(path, '^images/', ''), '^[LR]/', ''), '.jpg', '_mask.png') AS mask FROM p"""
    ),
)
def _export_manifest(spark, sf):
    kf = V.rows(spark, sf).filter("score > 0.55").select("video_id", "frame_index")
    out = Si.export_manifest(kf, lenses=("L", "R"), faces=("front",), angles=((90, -30),), splits=("up",), extension="jpg")
    return out.withColumn("mask", Si.mask_path("path", extension="png", flatten=True))


# ---- run state and parameters ----------------------------------------------


def _log(spark, sf):
    """A log of run events: one run per customer, one entry per order."""
    k = F.col("o_orderkey")
    event = F.when(k % 7 == 3, "failed").when(k % 7 == 5, "resumed").when(k % 7 == 6, "cleaned").otherwise("done")
    return V.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        k.alias("seq"),
        event.alias("event"),
        (k % 4).cast("string").alias("stage"),
        (k % 1000).alias("rows"),
        F.concat(F.lit("e"), k.cast("string")).alias("error"),
    )


_LOG_SQL = """WITH log AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 3 THEN 'failed' WHEN 5 THEN 'resumed' WHEN 6 THEN 'cleaned' ELSE 'done' END AS event,
  CAST(o_orderkey % 4 AS VARCHAR) AS stage, o_orderkey % 1000 AS rows, 'e' || o_orderkey AS error FROM orders)"""


@query(
    "run_manifest",
    "run_id:l stages:s resume_count:l failed:b failed_stage:s error:s cleanup_status:s",
    _LOG_SQL
    + """, r AS (SELECT run_id, coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (event = 'done'), '') AS stages, count(*) FILTER (event = 'resumed') AS resume_count,
      max(seq) FILTER (event = 'failed') AS f, max(seq) FILTER (event = 'cleaned') AS c, arg_max(stage, seq) FILTER (event = 'failed') AS fs,
      arg_max(error, seq) FILTER (event = 'failed') AS e FROM log GROUP BY run_id),
      s AS (SELECT *, f IS NOT NULL AND f > coalesce(c, -1) AS failed FROM r)
    SELECT run_id, stages, resume_count, failed, CASE WHEN failed THEN fs END AS failed_stage, CASE WHEN failed THEN e END AS error,
      CASE WHEN failed THEN 'retained_on_error' WHEN c IS NOT NULL THEN 'removed' ELSE 'pending' END AS cleanup_status FROM s""",
)
def _run_manifest(spark, sf):
    return St.run_manifest(_log(spark, sf)).withColumn("stages", F.array_join("completed_stages", ","))


@query(
    "stages_to_run",
    "run_id:l stage:s",
    _LOG_SQL
    + """ SELECT c_custkey AS run_id, CAST(s AS VARCHAR) AS stage FROM customer, (SELECT unnest(range(4)) AS s) q
    WHERE NOT EXISTS (SELECT 1 FROM log WHERE run_id = c_custkey AND stage = CAST(s AS VARCHAR) AND event = 'done')""",
)
def _stages_to_run(spark, sf):
    stages = F.explode(F.array(*[F.lit(s) for s in ("0", "1", "2", "3")]))
    wanted = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), stages.alias("stage"))
    return St.stages_to_run(wanted, _log(spark, sf))


@query(
    "params_overlay",
    "video_id:l weight_sharpness:d min_keyframe_interval:d quality_threshold:d violations:s",
    """WITH v AS (SELECT c_custkey AS video_id, c_custkey % 3 AS preset FROM customer),
      p AS (SELECT v.*, CASE preset WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 END AS ws, CASE preset WHEN 1 THEN 70 END AS mi FROM v),
      o AS (SELECT o_custkey AS video_id, min(o_orderkey) % 90 AS mi, max(o_orderkey) % 10 / 10.0 AS q FROM orders GROUP BY 1)
    SELECT p.video_id, coalesce(ws, 0.3) AS weight_sharpness, coalesce(o.mi, p.mi, 5) AS min_keyframe_interval, coalesce(o.q, 0.5) AS quality_threshold,
      concat_ws(',', CASE WHEN coalesce(ws, 0.3) + 0.7 > 1.01 THEN 'weight_sum' END, CASE WHEN coalesce(o.mi, p.mi, 5) >= 60 THEN 'interval_order' END) AS violations
    FROM p LEFT JOIN o USING (video_id)""",
)
def _params_overlay(spark, sf):
    videos = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_custkey") % 3).alias("preset"))
    presets = videos.select("preset").distinct().selectExpr(
        "preset",
        "CASE preset WHEN 0 THEN 0.3D WHEN 1 THEN 0.5D END AS weight_sharpness",
        "CASE preset WHEN 1 THEN 70D END AS min_keyframe_interval",
    )
    own = (
        V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("video_id"))
        .agg((F.min("o_orderkey") % 90).cast("double").alias("min_keyframe_interval"), (F.max("o_orderkey") % 10 / 10.0).alias("quality_threshold"))
    )
    defaults = {
        "weight_sharpness": 0.30,
        "weight_exposure": 0.15,
        "weight_geometric": 0.30,
        "weight_content": 0.25,
        "min_keyframe_interval": 5.0,
        "max_keyframe_interval": 60.0,
        "quality_threshold": 0.50,
    }
    out = St.params_overlay(videos, [(presets, ["preset"]), (own, ["video_id"])], defaults)
    return out.withColumn("violations", F.array_join("violations", ","))


@query(
    "run_compare",
    "stage:l throughput_fps:d time_change_pct:d fps_change_pct:d",
    """WITH t AS (SELECT l_suppkey AS stage, year(l_shipdate) % 2 AS run, sum(l_quantity) / 1000 AS e, count(*) AS n FROM lineitem GROUP BY ALL),
      f AS (SELECT *, CASE WHEN e > 1e-9 THEN n / e ELSE 0 END AS fps FROM t)
    SELECT a.stage, a.fps AS throughput_fps, (a.e - b.e) / b.e * 100 AS time_change_pct, (a.fps - b.fps) / b.fps * 100 AS fps_change_pct
    FROM f a JOIN f b ON a.stage = b.stage WHERE a.run = 1 AND b.run = 0""",
)
def _run_compare(spark, sf):
    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("stage"), (F.year("l_shipdate") % 2).alias("run")).agg(
        (F.sum("l_quantity") / 1000).alias("elapsed_seconds"), F.count(F.lit(1)).alias("frames")
    )
    t = St.stage_throughput(t)
    return St.run_compare(t.filter("run = 1"), t.filter("run = 0"))


# ---- streams ---------------------------------------------------------------


def _streamed(spark, df, job, index: str = "frame_index"):
    """Rows of ``job`` over a frame table that arrives in three parts of many files each.

    Every arrival starts the job anew, so it goes on from the state that the run before it left.
    """
    path = f"{scratch_root(spark)}/reelframe-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    df = written_table(df, "arrivals")
    for keep in (f"{index} < 20", f"{index} >= 20 AND {index} < 45", f"{index} >= 45"):
        df.filter(keep).write.mode("append").parquet(f"{path}/in")
        out = J.run_available(job(spark.readStream.schema(df.schema).parquet(f"{path}/in")), f"{path}/out")
    return out


@query(
    "stream_scores",
    "video_id:l frame_index:l quality:d is_pass:b",
    with_views(", " + gate_cte("frames_v", 35.0) + " SELECT *, drop_reason = 'pass' AS is_pass FROM gated"),
)
def _stream_scores(spark, sf):
    df = written_table(V.frames(spark, sf), "frames")
    bounds = written_table(O.percentile_bounds(df, KEYS), "bounds")
    return _streamed(spark, df, lambda stream: J.stream_scores(stream, bounds))


@query(
    "stream_events",
    "video_id:l frame_index:l exposure_changed:b is_rescue_mode:b is_late:b",
    with_views(
        """SELECT video_id, frame_index, coalesce(abs(brightness - lag(brightness) OVER w) > 0.3, false) AS exposure_changed,
        count(*) OVER r >= 10 AND avg(match_count) OVER r < 45 AS is_rescue_mode, false AS is_late FROM frames_v
        WINDOW w AS (PARTITION BY video_id ORDER BY frame_index), r AS (PARTITION BY video_id ORDER BY frame_index ROWS 9 PRECEDING)"""
    ),
)
def _stream_events(spark, sf):
    df = V.frames(spark, sf).select("video_id", "frame_index", "brightness", "match_count")
    return _streamed(spark, df, lambda stream: J.stream_events(stream, threshold=45.0))


@query(
    "stream_trajectory",
    "video_id:l frame_index:l x:d y:d z:d",
    f"""SELECT video_id, frame_index, tx - first_value(tx) OVER w AS x, ty - first_value(ty) OVER w AS y, tz - first_value(tz) OVER w AS z
    FROM ({QUERIES["integrate_trajectory"].sql}) AS p WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)""",
)
def _stream_trajectory(spark, sf):
    df = _steps(spark, sf)
    df = attach(df, median_step(df, KEYS), KEYS, F.col("frame_index"))
    return _streamed(spark, df, J.stream_trajectory)


@query(
    "stream_chain",
    "video_id:l frame_index:l is_keyframe:b",
    with_views(
        """, fold AS (SELECT video_id, frame_index, frame_index AS last, flow_mag AS ref, true AS k FROM frames_v WHERE frame_index = 0
          UNION ALL SELECT n.video_id, n.frame_index, CASE WHEN ok THEN n.frame_index ELSE last END, CASE WHEN ok THEN n.flow_mag ELSE ref END, ok FROM (
            SELECT n.*, f.last, f.ref, n.frame_index - f.last >= 3 AND 1 - abs(n.flow_mag - f.ref) / 60 <= 0.85 AS ok
            FROM fold f JOIN frames_v n ON n.video_id = f.video_id AND n.frame_index = f.frame_index + 1) n)
        SELECT video_id, frame_index, k AS is_keyframe FROM fold""",
        recursive=True,
    ),
)
def _stream_chain(spark, sf):
    df = V.frames(spark, sf).select("video_id", "frame_index", F.array("flow_mag").alias("features"))
    near = lambda a, b: 1 - abs(float(b[0]) - float(a[0])) / 60
    return _streamed(spark, df, lambda stream: J.stream_chain(stream, similarity=near, min_interval=3))
