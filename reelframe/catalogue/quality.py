"""Queries over quality metrics, scores and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import query
from reelframe.catalogue.views import with_views
from reelframe.functions import quality as Q
from reelframe.functions import scores as S
from reelframe.operators import calibrations
from reelframe.operators import quality as O
from reelframe.plans.percentiles import exact_percentiles
from reelframe.session import written_table

_BOUNDS = """bounds AS (SELECT video_id,
    quantile_cont(laplacian_var, 0.1) AS lo1, quantile_cont(laplacian_var, 0.9) AS hi1,
    quantile_cont(tenengrad, 0.1) AS lo2, quantile_cont(tenengrad, 0.9) AS hi2,
    quantile_cont(exposure, 0.1) AS lo3, quantile_cont(exposure, 0.9) AS hi3,
    quantile_cont(CAST(orb_keypoints AS DOUBLE), 0.1) AS lo4, quantile_cont(CAST(orb_keypoints AS DOUBLE), 0.9) AS hi4
  FROM {view} GROUP BY video_id)"""


def _norm(field: str, i: int) -> str:
    return (
        f"CASE WHEN hi{i} - lo{i} <= 1e-12 THEN 0.5 "
        f"ELSE least(greatest(({field} - lo{i}) / (hi{i} - lo{i}), 0), 1) END"
    )


_GATE = """gated AS (SELECT *, CASE WHEN laplacian_var < {guard} THEN 'abs_laplacian_guard'
    WHEN quality < 0.5 THEN 'quality_below_threshold' ELSE 'pass' END AS drop_reason FROM (
    SELECT s.*, least(greatest(0.4 * {n1} + 0.3 * {n2} + 0.15 * {n3} + 0.15 * {n4}, 0), 1) AS quality
    FROM {view} s JOIN bounds USING (video_id)) q)"""


def gate_cte(view: str, guard: float) -> str:
    return (
        _BOUNDS.format(view=view)
        + ", "
        + _GATE.format(
            view=view,
            guard=guard,
            n1=_norm("laplacian_var", 1),
            n2=_norm("tenengrad", 2),
            n3=_norm("exposure", 3),
            n4=_norm("orb_keypoints", 4),
        )
    )


@query(
    "quality_gate",
    "video_id:l frame_index:l quality:d is_pass:b drop_reason:s",
    with_views(", " + gate_cte("frames_v", 35.0) + " SELECT *, drop_reason = 'pass' AS is_pass FROM gated"),
)
def _quality_gate(spark, sf):
    return O.quality_gate(V.frames(spark, sf))


@query(
    "quality_gate_scan",
    "video_id:l frame_index:l quality:d is_pass:b drop_reason:s",
    with_views(", " + gate_cte("scan_v", 20000.0) + " SELECT *, drop_reason = 'pass' AS is_pass FROM gated"),
)
def _quality_gate_scan(spark, sf):
    return O.quality_gate(V.scan(spark, sf), abs_min=20000.0)


@query(
    "percentile_bounds",
    "video_id:l lo1:d hi1:d lo2:d hi2:d lo3:d hi3:d lo4:d hi4:d",
    with_views(", " + _BOUNDS.format(view="rows_v") + " SELECT * FROM bounds"),
)
def _percentile_bounds(spark, sf):
    b = O.percentile_bounds(V.rows(spark, sf), ["video_id"])
    return b.select(
        "video_id",
        *[
            F.col(f"{f}_{side}").alias(f"{short}{i}")
            for i, f in enumerate(O.FIELDS, 1)
            for side, short in (("low", "lo"), ("high", "hi"))
        ],
    )


@query(
    "normalize",
    "video_id:l frame_index:l n1:d n2:d n3:d n4:d",
    with_views(
        ", "
        + _BOUNDS.format(view="rows_v")
        + f""" SELECT video_id, frame_index, {_norm('laplacian_var', 1)} AS n1, {_norm('tenengrad', 2)} AS n2,
        {_norm('exposure', 3)} AS n3, {_norm('orb_keypoints', 4)} AS n4 FROM rows_v JOIN bounds USING (video_id)"""
    ),
)
def _normalize(spark, sf):
    df = V.rows(spark, sf)
    out = O.normalize(df, O.percentile_bounds(df, ["video_id"]), ["video_id"])
    return out.select("video_id", "frame_index", *[F.col(f"norm_{f}").alias(f"n{i}") for i, f in enumerate(O.FIELDS, 1)])


@query(
    "compose_quality",
    "video_id:l frame_index:l quality:d quality_flat:d guard_ok:b",
    with_views(
        """SELECT video_id, frame_index,
        least(greatest((0.4 * exposure + 0.3 * motion_blur + 0.15 * ssim + 0.15 * inlier_ratio) / 1.0, 0), 1) AS quality,
        least(greatest((2 * exposure + 1 * motion_blur + 1 * ssim) / 4.0, 0), 1) AS quality_flat,
        laplacian_var >= 35 AS guard_ok FROM rows_v"""
    ),
)
def _compose_quality(spark, sf):
    fields = dict(zip(O.FIELDS, [F.col(c) for c in ("exposure", "motion_blur", "ssim", "inlier_ratio")]))
    flat = {"laplacian_var": 2.0, "tenengrad": 1.0, "exposure": 1.0, "orb_keypoints": 0.0}
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        Q.compose_quality(fields).alias("quality"),
        Q.compose_quality(fields, flat).alias("quality_flat"),
        Q.abs_guard("laplacian_var").alias("guard_ok"),
    )


@query(
    "legacy_gate",
    "video_id:l frame_index:l quality:d is_pass:b drop_reason:s",
    with_views(
        """SELECT video_id, frame_index,
        (least(laplacian_var / 100, 1) + least(exposure / 0.35, 1) + least(greatest(1 - motion_blur / 0.3, 0), 1)) / 3 AS quality,
        laplacian_var >= 100 AND motion_blur <= 0.3 AND exposure >= 0.35 AS is_pass,
        CASE WHEN laplacian_var >= 100 AND motion_blur <= 0.3 AND exposure >= 0.35 THEN 'pass'
          ELSE 'legacy_threshold' END AS drop_reason FROM rows_v"""
    ),
)
def _legacy_gate(spark, sf):
    ok = Q.legacy_gate("laplacian_var", "exposure", "motion_blur")
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        Q.legacy_proxy("laplacian_var", "exposure", "motion_blur").alias("quality"),
        ok.alias("is_pass"),
        F.when(ok, Q.PASS).otherwise(Q.LEGACY).alias("drop_reason"),
    )


@query(
    "combined_score",
    "video_id:l frame_index:l score:d score_bare:d",
    with_views(
        """SELECT video_id, frame_index,
        least(greatest(0.3 * least(laplacian_var / 1000, 1) + 0.15 * exposure
          + 0.3 * CASE WHEN vo_valid THEN (inlier_ratio + 0.5 + motion_blur + 0.5) / 4 ELSE 0.5 END
          + 0.25 * CASE WHEN vo_attempted THEN ((1 - ssim) + least(flow_mag / 50, 1)) / 2 ELSE 0.5 END, 0), 1) AS score,
        0.3 * least(laplacian_var / 1000, 1) + 0.15 * exposure + 0.55 * 0.5 AS score_bare FROM rows_v"""
    ),
)
def _combined_score(spark, sf):
    seen = lambda c, on: F.when(F.col(on), F.col(c))
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        S.combined_score(
            "laplacian_var",
            "exposure",
            (seen("inlier_ratio", "vo_valid"), F.lit(None).cast("double"), seen("motion_blur", "vo_valid"), F.lit(None).cast("double")),
            (seen("ssim", "vo_attempted"), seen("flow_mag", "vo_attempted")),
        ).alias("score"),
        S.combined_score("laplacian_var", "exposure", None, None).alias("score_bare"),
    )


@query(
    "motion_risk",
    "video_id:l frame_index:l risk:d roi:d step:l",
    with_views(
        """SELECT video_id, frame_index,
        0.4 * greatest(1 - least(laplacian_var / 100, 1), 0) + 0.4 * least(flow_mag / 50, 1)
          + 0.2 * least(greatest(1 - ssim, 0), 1) AS risk,
        0.45 + 0.25 * least(flow_mag / 50, 1) AS roi,
        greatest(1, round_even(1 + (1 - least(flow_mag / 50, 1)) * 7, 0)) AS step FROM rows_v"""
    ),
)
def _motion_risk(spark, sf):
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        S.motion_risk("laplacian_var", "flow_mag", "ssim").alias("risk"),
        S.adaptive_roi("flow_mag").alias("roi"),
        S.effective_subsample("flow_mag", 8).alias("step"),
    )


@query(
    "vo_schedule",
    "video_id:l frame_index:l attempted:b reason:s",
    with_views(
        """, stepped AS (SELECT *, frame_index > 0 AND frame_index %
          greatest(1, CAST(round_even(1 + (1 - least(flow_mag / 50, 1)) * 3, 0) AS BIGINT)) = 0 AS attempted FROM frames_v)
        SELECT video_id, frame_index, attempted, CASE WHEN frame_index > 0 AND NOT attempted THEN 'frame_subsample_skip'
          WHEN attempted AND vo_valid THEN 'enabled' WHEN attempted THEN 'estimate_failed_or_low_inlier'
          ELSE 'not_evaluated' END AS reason FROM stepped"""
    ),
)
def _vo_schedule(spark, sf):
    on = F.lit(True)
    df = V.frames(spark, sf).withColumn(
        "attempted", S.vo_schedule(on, F.col("frame_index"), S.effective_subsample("flow_mag", 4))
    )
    ok = F.col("attempted") & F.col("vo_valid")
    reason = S.vo_status_reason(on, F.col("frame_index") > 0, F.col("attempted"), ok, F.lit("not_evaluated"))
    return df.withColumn("reason", reason)


@query(
    "vo_runtime_status",
    "supplier:l reason:s",
    """SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 5 = 0 THEN 'vo_disabled_by_config'
      WHEN n_nationkey IS NULL THEN 'calibration_unavailable'
      WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'projection_mode_unsupported' ELSE 'enabled' END AS reason
    FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) n ON s_nationkey = n_nationkey""",
)
def _vo_runtime_status(spark, sf):
    calib = V.table(spark, sf, "nation").filter("n_regionkey <> 3").select("n_nationkey")
    s = V.table(spark, sf, "supplier").join(calib, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("supplier"),
        S.vo_runtime_reason(
            key % 5 != 0,
            F.col("n_nationkey").isNotNull(),
            F.when(key % 3 == 0, " Equirectangular").otherwise("fisheye"),
            key % 2 == 1,
        ).alias("reason"),
    )


@query(
    "vo_runtime_calibrations",
    "supplier:l mono:s front:s rear:s enabled:b reason:s loaded:b",
    """WITH c AS (SELECT 'n' || n_nationkey AS xml FROM nation WHERE n_regionkey <> 3),
    r AS (SELECT s_suppkey AS supplier, s_suppkey % 3 AS kind, s_suppkey % 11 <> 0 AS vo, s_suppkey % 5 = 0 AS pano,
        CASE WHEN s_suppkey % 4 <> 0 THEN 'n' || s_nationkey END AS m,
        CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_suppkey % 30 END AS f,
        CASE WHEN s_suppkey % 7 <> 0 THEN 'n' || (s_suppkey + s_nationkey) % 30 END AS b FROM supplier),
    l AS (SELECT r.*, cm.xml AS own, cf.xml AS front_own, cb.xml AS rear_own FROM r
        LEFT JOIN c cm ON cm.xml = r.m AND kind <> 1
        LEFT JOIN c cf ON cf.xml = coalesce(r.f, r.m) AND kind <> 0
        LEFT JOIN c cb ON cb.xml = coalesce(r.b, r.m) AND kind <> 0),
    u AS (SELECT *, CASE WHEN kind = 2 THEN coalesce(front_own, own) ELSE front_own END AS fr,
        CASE WHEN kind = 2 THEN coalesce(rear_own, own) ELSE rear_own END AS re FROM l),
    s AS (SELECT *, CASE WHEN kind = 0 THEN own ELSE coalesce(fr, own) END IS NOT NULL AS has FROM u)
    SELECT supplier, own AS mono, fr AS front, re AS rear, vo AND has AND NOT (kind = 0 AND pano) AS enabled,
      CASE WHEN NOT vo THEN 'vo_disabled_by_config' WHEN NOT has THEN 'calibration_unavailable'
        WHEN kind = 0 AND pano THEN 'projection_mode_unsupported' ELSE 'enabled' END AS reason, vo AND has AS loaded FROM s""",
)
def _vo_runtime_calibrations(spark, sf):
    key, home = F.col("s_suppkey"), F.col("s_nationkey")
    runs = V.table(spark, sf, "supplier").select(
        key.alias("supplier"),
        F.element_at(F.array(F.lit("single"), F.lit(" Front_Rear"), F.lit("stereo")), (key % 3 + 1).cast("int")).alias("layout"),
        (key % 11 != 0).alias("vo_enabled"),
        F.when(key % 5 == 0, "cubemap").otherwise("fisheye").alias("projection"),
        F.when(key % 4 != 0, F.concat(F.lit("n"), home)).alias("mono_xml"),
        F.when(key % 2 == 0, F.concat(F.lit("n"), key % 30)).otherwise(" ").alias("front_xml"),
        F.when(key % 7 != 0, F.concat(F.lit("n"), (key + home) % 30)).alias("rear_xml"),
    )
    terms = F.when(F.col("n_regionkey") == 3, 8).otherwise(9)  # a matrix of eight numbers can't be used
    files = V.table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("xml_path"),
        F.transform(F.sequence(F.lit(1), terms), lambda x: x.cast("double")).alias("camera_matrix"),
        F.array(F.lit(0.1), F.lit(0.2)).alias("dist"),
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        F.lit("opencv").alias("model"),
    )
    out = calibrations.vo_runtime_status(runs, files, ["supplier"])
    names = [F.col(f"{lens}.xml_path").alias(lens) for lens in calibrations.LENSES]
    return out.select("supplier", *names, "enabled", "reason", F.col("calibration_loaded").alias("loaded"))


@query(
    "vo_confidence",
    "video_id:l frame_index:l confidence:d band:s r:l g:l b:l",
    with_views(
        """, c AS (SELECT *, least(greatest(0.4 * inlier_ratio + 0.2 * exposure + 0.2 * least(match_count / 24, 1)
           + 0.2 * motion_blur, 0), 1) AS confidence FROM rows_v)
        SELECT video_id, frame_index, confidence,
          CASE WHEN confidence < 0.35 THEN 'low' WHEN confidence < 0.55 THEN 'mid' ELSE 'high' END AS band,
          CASE WHEN NOT vo_valid THEN 120 WHEN confidence >= 0.5 THEN round_even(255 * (1 - (confidence - 0.5) / 0.5), 0) ELSE 255 END AS r,
          CASE WHEN NOT vo_valid THEN 120 WHEN confidence >= 0.5 THEN 255 ELSE round_even(255 * (confidence / 0.5), 0) END AS g,
          CASE WHEN NOT vo_valid THEN 120 ELSE 0 END AS b FROM c"""
    ),
)
def _vo_confidence(spark, sf):
    c = S.vo_confidence("inlier_ratio", "exposure", S.track_sufficiency("match_count"), "motion_blur")
    df = V.rows(spark, sf).withColumn("confidence", c)
    rgb = S.confidence_rgb(F.col("vo_valid"), "confidence")
    return df.select(
        "video_id",
        "frame_index",
        "confidence",
        S.confidence_band("confidence").alias("band"),
        *[rgb[i].alias(n) for i, n in enumerate("rgb")],
    )


@query(
    "stage3_score",
    "video_id:l frame_index:l stage3:d effective:d",
    with_views(
        """SELECT video_id, frame_index, exposure * (0.5 + 0.5 * inlier_ratio) AS effective,
        least(greatest(0.7 * score + 0.25 * exposure * (0.5 + 0.5 * inlier_ratio) - 0.05 * motion_blur, 0), 1) AS stage3
        FROM rows_v"""
    ),
)
def _stage3_score(spark, sf):
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        S.stage3_score("score", "exposure", "inlier_ratio", "motion_blur").alias("stage3"),
        S.effective_trajectory("exposure", "inlier_ratio").alias("effective"),
    )


@query(
    "adaptive_interval",
    "video_id:l frame_index:l interval:l exposure_gauss:d",
    with_views(
        """SELECT video_id, frame_index,
        floor(least(greatest(10 / ((1.5 - 1 / (1 + exp(-flow_mag / 10))) * 2), 5), 60)) AS interval,
        exp(-((brightness * 255 - 128) ** 2) / (2.0 * 80 * 80)) AS exposure_gauss FROM rows_v"""
    ),
)
def _adaptive_interval(spark, sf):
    return V.rows(spark, sf).select(
        "video_id",
        "frame_index",
        S.adaptive_interval("flow_mag").alias("interval"),
        Q.gray_exposure(F.col("brightness") * 255).alias("exposure_gauss"),
    )


@query(
    "parse_roi_spec",
    "part:l mode:s ratio:d",
    """SELECT p_partkey AS part, CASE WHEN trim(split_part(spec, ':', 1)) IN ('circle', 'rect')
        THEN trim(split_part(spec, ':', 1)) ELSE 'circle' END AS mode,
      least(greatest(coalesce(try_cast(trim(split_part(spec, ':', 2)) AS DOUBLE), 0.4), 0.05), 1) AS ratio
    FROM (SELECT p_partkey, lower(trim(CASE p_partkey % 5 WHEN 0 THEN ' Rect:0.' || (p_partkey % 90 + 10)
       WHEN 1 THEN 'circle:2.5' WHEN 2 THEN 'oval : 0.01' WHEN 3 THEN 'rect' ELSE 'circle:wide' END)) AS spec FROM part) p""",
)
def _parse_roi_spec(spark, sf):
    key = F.col("p_partkey")
    spec = (
        F.when(key % 5 == 0, F.concat(F.lit(" Rect:0."), (key % 90 + 10).cast("string")))
        .when(key % 5 == 1, "circle:2.5")
        .when(key % 5 == 2, "oval : 0.01")
        .when(key % 5 == 3, "rect")
        .otherwise("circle:wide")
    )
    return (
        V.table(spark, sf, "part")
        .select(key.alias("part"), spec.alias("spec"))
        .select("part", Q.roi_mode("spec").alias("mode"), Q.roi_ratio("spec").alias("ratio"))
    )


@query(
    "quality_summary",
    "video_id:l total_records:l passed_records:l pass_ratio:d quality_min:d quality_max:d quality_median:d reasons:s",
    with_views(
        ", "
        + gate_cte("rows_v", 35.0)
        + """, counts AS (SELECT video_id, string_agg(drop_reason || '=' || n, ',' ORDER BY drop_reason) AS reasons
            FROM (SELECT video_id, drop_reason, count(*) AS n FROM gated GROUP BY ALL) c GROUP BY video_id)
        SELECT video_id, count(*) AS total_records, count(*) FILTER (drop_reason = 'pass') AS passed_records,
          count(*) FILTER (drop_reason = 'pass') / count(*) AS pass_ratio, min(quality) AS quality_min,
          max(quality) AS quality_max, quantile_cont(quality, 0.5) AS quality_median, any_value(reasons) AS reasons
        FROM gated JOIN counts USING (video_id) GROUP BY video_id"""
    ),
)
def _quality_summary(spark, sf):
    out = O.quality_summary(written_table(O.quality_gate(V.rows(spark, sf)), "stage1"))
    return out.withColumn("reasons", _counts_text("drop_reason_counts"))


def _counts_text(c: str):
    entry = lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), entry), ",")


def _vo_rows(spark, sf):
    return V.frames(spark, sf).select(
        "video_id",
        "frame_index",
        "vo_attempted",
        "vo_valid",
        (F.col("vo_valid") & (F.col("orb_keypoints") >= 20)).alias("vo_pose_valid"),
        F.col("vo_valid").alias("has_pose"),
        F.col("event_type").alias("vo_status_reason"),
        F.col("inlier_ratio").alias("vo_confidence"),
    )


@query(
    "vo_summary",
    "video_id:l total_records:l attempted:l valid:l pose_valid:l trajectory_points:l valid_ratio:d dominant_reason:s "
    "confidence_mean:d confidence_p10:d confidence_p50:d confidence_p90:d reasons:s",
    with_views(
        """, reasons AS (SELECT video_id, event_type, count(*) AS n, min(frame_index) AS first_at FROM frames_v GROUP BY ALL),
        top AS (SELECT video_id, arg_min(event_type, (-n, first_at)) AS dominant_reason,
          string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reasons FROM reasons GROUP BY video_id)
        SELECT video_id, count(*) AS total_records, count(*) FILTER (vo_attempted) AS attempted,
          count(*) FILTER (vo_valid) AS valid, count(*) FILTER (vo_valid AND orb_keypoints >= 20) AS pose_valid,
          count(*) FILTER (vo_valid) AS trajectory_points,
          CASE WHEN count(*) FILTER (vo_attempted) > 0 THEN count(*) FILTER (vo_valid) / count(*) FILTER (vo_attempted) ELSE 0 END AS valid_ratio,
          any_value(dominant_reason) AS dominant_reason, avg(inlier_ratio) AS confidence_mean,
          quantile_cont(inlier_ratio, 0.1) AS confidence_p10, quantile_cont(inlier_ratio, 0.5) AS confidence_p50,
          quantile_cont(inlier_ratio, 0.9) AS confidence_p90, any_value(reasons) AS reasons
        FROM frames_v JOIN top USING (video_id) GROUP BY video_id"""
    ),
)
def _vo_summary(spark, sf):
    return O.vo_summary(_vo_rows(spark, sf)).withColumn("reasons", _counts_text("reason_counts"))


@query(
    "vo_runtime_summary",
    "video_id:l attempted:l valid:l pose_valid:l runtime_enabled:b runtime_reason:s",
    with_views(
        """, named AS (SELECT *, CASE event_type WHEN 'error' THEN 'calibration_unavailable' WHEN 'signup'
           THEN 'vo_disabled_by_config' WHEN 'view' THEN 'enabled' ELSE 'projection_mode_unsupported' END AS reason FROM frames_v),
        reasons AS (SELECT video_id, reason, count(*) AS n, min(frame_index) AS first_at FROM named GROUP BY ALL),
        top AS (SELECT video_id, arg_min(reason, (-n, first_at)) AS runtime_reason FROM reasons GROUP BY video_id)
        SELECT video_id, count(*) FILTER (vo_attempted) AS attempted, count(*) FILTER (vo_valid) AS valid,
          count(*) FILTER (vo_valid AND orb_keypoints >= 20) AS pose_valid,
          bool_or(reason NOT IN ('calibration_unavailable', 'projection_mode_unsupported', 'vo_disabled_by_config')) AS runtime_enabled,
          any_value(runtime_reason) AS runtime_reason FROM named JOIN top USING (video_id) GROUP BY video_id"""
    ),
)
def _vo_runtime_summary(spark, sf):
    reason = F.expr(
        "CASE vo_status_reason WHEN 'error' THEN 'calibration_unavailable' WHEN 'signup' THEN 'vo_disabled_by_config' "
        "WHEN 'view' THEN 'enabled' ELSE 'projection_mode_unsupported' END"
    )
    return O.vo_runtime_summary(_vo_rows(spark, sf).withColumn("vo_status_reason", reason))


@query(
    "quantile_threshold",
    "video_id:l flow_th:d rot_th:d fixed_th:d",
    with_views(
        """SELECT video_id, quantile_cont(flow_mag, 0.1) AS flow_th, quantile_cont(rotation_delta, 0.1) AS rot_th,
        2.5 AS fixed_th FROM rows_v GROUP BY video_id"""
    ),
)
def _quantile_threshold(spark, sf):
    df = V.rows(spark, sf)
    q = O.quantile_threshold(df, ["video_id"], ["flow_mag", "rotation_delta"])
    fixed = O.quantile_threshold(df, ["video_id"], ["flow_mag"], fixed={"flow_mag": 2.5}, use_quantile=False)
    return q.join(fixed.withColumnRenamed("flow_mag_th", "fixed_th"), "video_id").select(
        "video_id", F.col("flow_mag_th").alias("flow_th"), F.col("rotation_delta_th").alias("rot_th"), "fixed_th"
    )


@query(
    "scan_summary",
    "video_id:l sampled:l passed:l pass_ratio:d mean_score:d",
    with_views(
        """SELECT video_id, count(*) AS sampled, count(*) FILTER (laplacian_var >= 35) AS passed,
        count(*) FILTER (laplacian_var >= 35) / count(*) AS pass_ratio, avg(score) AS mean_score
        FROM rows_v GROUP BY video_id"""
    ),
)
def _scan_summary(spark, sf):
    return O.scan_summary(V.rows(spark, sf).withColumn("is_pass", Q.abs_guard("laplacian_var")))


@query(
    "unreliable_switch",
    "video_id:l valid_ratio:d w_base:d w_trajectory:d",
    with_views(
        """, r AS (SELECT video_id, CASE WHEN count(*) FILTER (vo_attempted) > 0
          THEN count(*) FILTER (vo_valid) / count(*) FILTER (vo_attempted) ELSE 0 END AS valid_ratio,
          count(*) FILTER (vo_attempted) AS attempted FROM rows_v GROUP BY video_id)
        SELECT video_id, valid_ratio, CASE WHEN attempted > 0 AND valid_ratio < 0.75 THEN 0.95 ELSE 0.7 END AS w_base,
          CASE WHEN attempted > 0 AND valid_ratio < 0.75 THEN 0 ELSE 0.25 END AS w_trajectory FROM r"""
    ),
)
def _unreliable_switch(spark, sf):
    return O.unreliable_switch(V.rows(spark, sf), min_ratio=0.75)


@query(
    "percentiles_of_large_groups",
    "flag:s price_n:l price_p0:d price_p1:d price_p2:d quantity_n:l quantity_p0:d quantity_p1:d quantity_p2:d",
    """SELECT l_returnflag || l_linestatus AS flag, count(p) AS price_n, quantile_cont(p, 0.013) AS price_p0, quantile_cont(p, 0.5) AS price_p1,
      quantile_cont(p, 0.99) AS price_p2, count(q) AS quantity_n, quantile_cont(q, 0.013) AS quantity_p0, quantile_cont(q, 0.5) AS quantity_p1,
      quantile_cont(q, 0.99) AS quantity_p2
    FROM (SELECT *, CASE WHEN l_partkey % 7 > 0 THEN l_extendedprice END::DOUBLE AS p, l_quantity::DOUBLE AS q FROM lineitem) AS l GROUP BY 1""",
)
def _percentiles_of_large_groups(spark, sf):
    """Some groups hold a hundred times as many rows as are aggregated at once."""
    li = V.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("flag"),
        F.when(F.col("l_partkey") % 7 > 0, F.col("l_extendedprice")).alias("price"),
        F.col("l_quantity").alias("quantity"),
    )
    return exact_percentiles(li, ["flag"], ["price", "quantity"], [0.013, 0.5, 0.99], small=300)
