"""Queries over matches, key points, tracks, detections and camera poses."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import query
from reelframe.catalogue.views import with_views
from reelframe.functions import pose as Po
from reelframe.operators import geometry as G
from reelframe.operators import pairs as P
from reelframe.session import written_table

# Point matches between two frames, one pair per supplier.
_MATCH = {
    "x1": "CAST(l_partkey % 640 AS DOUBLE)",
    "y1": "CAST(l_orderkey % 480 AS DOUBLE)",
    "x2": "CAST(l_partkey % 640 AS DOUBLE) + l_quantity / 25.0 - 1.0",
    "y2": "CAST(l_orderkey % 480 AS DOUBLE) + l_discount * 20.0 - 1.0",
}
_MATCH_SQL = (
    "matches AS (SELECT l_suppkey AS pair_id, l_orderkey * 8 + l_linenumber AS match_id, l_tax <= 0.06 AS inlier, "
    "CAST(l_returnflag <> 'R' AS INT) AS status, "
    + ", ".join(f"{e} AS {c}" for c, e in _MATCH.items())
    + " FROM lineitem)"
)
_H = ("1.0 + s_acctbal / 1e7", "0.001", "0.4", "-0.002", "1.0", "s_suppkey % 7 / 10.0", "1e-6", "0.0", "1.0")
_F = ("0.0", "-0.001", "0.02", "0.001", "0.0", "-0.9 - s_acctbal / 1e5", "-0.02", "0.9", "s_suppkey % 5 / 10.0")
_MODEL_SQL = "models AS (SELECT s_suppkey AS pair_id, " + ", ".join(
    [f"CAST({e} AS DOUBLE) AS h{i}" for i, e in enumerate(_H)] + [f"CAST({e} AS DOUBLE) AS f{i}" for i, e in enumerate(_F)]
) + " FROM supplier)"


def _matches(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("pair_id"),
        F.expr("l_orderkey * 8 + l_linenumber").alias("match_id"),
        F.expr("l_tax <= 0.06").alias("inlier"),
        F.expr("CAST(l_returnflag <> 'R' AS INT)").alias("status"),
        *[F.expr(e).alias(c) for c, e in _MATCH.items()],
    )


def _models(spark, sf):
    arr = lambda es: F.array(*[F.expr(f"CAST({e} AS DOUBLE)") for e in es])
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pair_id"), arr(_H).alias("h"), arr(_F).alias("f"))


_RESIDUAL_SQL = (
    _MATCH_SQL
    + ", "
    + _MODEL_SQL
    + """, det AS (SELECT *, h0 * (h4 * h8 - h5 * h7) - h1 * (h3 * h8 - h5 * h6) + h2 * (h3 * h7 - h4 * h6) AS d FROM models),
    inv AS (SELECT *, (h4*h8-h5*h7)/d AS i0, (h2*h7-h1*h8)/d AS i1, (h1*h5-h2*h4)/d AS i2, (h5*h6-h3*h8)/d AS i3, (h0*h8-h2*h6)/d AS i4,
      (h2*h3-h0*h5)/d AS i5, (h3*h7-h4*h6)/d AS i6, (h1*h6-h0*h7)/d AS i7, (h0*h4-h1*h3)/d AS i8 FROM det),
    pr AS (SELECT m.*, h0*x1+h1*y1+h2 AS pu, h3*x1+h4*y1+h5 AS pv, h6*x1+h7*y1+h8 AS pw, i0*x2+i1*y2+i2 AS qu, i3*x2+i4*y2+i5 AS qv,
      i6*x2+i7*y2+i8 AS qw, f0*x1+f1*y1+f2 AS a0, f3*x1+f4*y1+f5 AS a1, f6*x1+f7*y1+f8 AS a2, f0*x2+f3*y2+f6 AS t0, f1*x2+f4*y2+f7 AS t1
      FROM matches m JOIN inv USING (pair_id)),
    res AS (SELECT *, ((pu/pw-x2)**2 + (pv/pw-y2)**2 + (qu/qw-x1)**2 + (qv/qw-y1)**2) / 2 AS err_h,
      (x2*a0+y2*a1+a2)**2 / greatest(a0*a0+a1*a1+t0*t0+t1*t1, 1e-10) AS err_f FROM pr)"""
)
_GRIC_SQL = """, g AS (SELECT pair_id, sum(least(err_h, 4)) + 2 * 2 * count(*) + 4 * 8 AS gric_h,
    sum(least(err_f, 2)) + 2 * 3 * count(*) + 4 * 7 AS gric_f, count(*) AS n,
    avg(CASE WHEN err_h <= 1 THEN 1.0 ELSE 0.0 END) AS ratio_h, avg(CASE WHEN err_f <= 1 THEN 1.0 ELSE 0.0 END) AS ratio_f
    FROM res GROUP BY pair_id)"""


@query("model_residuals", "pair_id:l match_id:l x1:d x2:d err_h:d err_f:d", f"WITH {_RESIDUAL_SQL} SELECT * FROM res")
def _model_residuals(spark, sf):
    return G.model_residuals(_matches(spark, sf), _models(spark, sf), ["pair_id"])


def _gric(spark, sf):
    r = G.model_residuals(_matches(spark, sf), _models(spark, sf), ["pair_id"])
    r = r.withColumn("inlier_h", F.col("err_h") <= 1).withColumn("inlier_f", F.col("err_f") <= 1)
    return G.gric(r, ["pair_id"])


@query("gric", "pair_id:l gric_h:d gric_f:d n:l ratio_h:d ratio_f:d", f"WITH {_RESIDUAL_SQL} {_GRIC_SQL} SELECT * FROM g")
def _gric_query(spark, sf):
    return _gric(spark, sf)


@query(
    "gric_decision",
    "pair_id:l status:s score:d",
    f"""WITH {_RESIDUAL_SQL} {_GRIC_SQL}, r AS (SELECT *, CASE WHEN gric_f < gric_h
        THEN least(greatest(0.5 + (gric_h - gric_f) / (gric_h + gric_f + 1e-10), 0.3), 1)
        ELSE least(greatest(0.5 - (gric_f - gric_h) / (gric_h + gric_f + 1e-10), 0), 0.5) END AS raw FROM g),
      s AS (SELECT *, CASE WHEN n < 15 THEN 'insufficient_features' WHEN ratio_h < 0.05 AND ratio_f < 0.05 THEN 'estimation_failure'
        WHEN ratio_h >= 0.3 THEN 'degenerate' WHEN gric_f >= gric_h AND raw < 0.15 THEN 'degenerate' ELSE 'ok' END AS status FROM r)
    SELECT pair_id, status, CASE status WHEN 'ok' THEN raw WHEN 'degenerate' THEN 0.1 ELSE 0.05 END AS score FROM s""",
)
def _gric_decision(spark, sf):
    return G.gric_decision(_gric(spark, sf), min_inlier=0.05, degenerate=0.3)


@query(
    "flow_magnitude",
    "pair_id:l flow_mag:d",
    f"""WITH {_MATCH_SQL} SELECT pair_id, coalesce(avg(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) FILTER (status = 1), 0) / 0.5 AS flow_mag
    FROM matches GROUP BY pair_id""",
)
def _flow_magnitude(spark, sf):
    return G.flow_magnitude(_matches(spark, sf), ["pair_id"], downscale=0.5)


@query(
    "step_proxy",
    "pair_id:l step_proxy:d match_count:l inliers:l inlier_ratio:d is_valid:b",
    f"""WITH {_MATCH_SQL} SELECT pair_id, least(coalesce(quantile_cont(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 0.5) FILTER (inlier), 0), 0.8) AS step_proxy,
      count(*) AS match_count, count(*) FILTER (inlier) AS inliers, count(*) FILTER (inlier) / count(*) AS inlier_ratio,
      count(*) >= 24 AND count(*) FILTER (inlier) > 0 AND count(*) FILTER (inlier) / count(*) >= 0.8 AS is_valid
    FROM matches GROUP BY pair_id""",
)
def _step_proxy(spark, sf):
    t = _matches(spark, sf)
    return G.step_proxy(t, ["pair_id"], clip_px=0.8).join(G.inlier_gate(t, ["pair_id"], fast_fail=0.8), "pair_id")


@query(
    "pair_flow",
    "order_id:l flow_max:d flow_mean:d",
    """SELECT a.l_orderkey AS order_id, greatest(a.q, b.q) AS flow_max, (a.q + b.q) * 0.5 AS flow_mean
    FROM (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) a
    JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1) b USING (l_orderkey)""",
)
def _pair_flow(spark, sf):
    from reelframe.operators.quality import pair_flow

    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    side = lambda odd, c: li.filter(F.col("l_linenumber") % 2 == odd).groupBy("l_orderkey").agg(F.sum("l_quantity").alias(c))
    out = side(0, "a").join(side(1, "b"), "l_orderkey")
    return out.select(F.col("l_orderkey").alias("order_id"), pair_flow("a", "b").alias("flow_max"), pair_flow("a", "b", "mean").alias("flow_mean"))


def _points(spark, sf):
    return V.scan(spark, sf).select(
        F.col("video_id").alias("frame"),
        F.col("frame_index").alias("point_id"),
        F.expr("orb_keypoints * 1.3").alias("x"),
        F.expr("CAST(floor(laplacian_var) % 480 AS DOUBLE)").alias("y"),
    )


_POINT_SQL = ", pts AS (SELECT video_id AS frame, frame_index AS point_id, orb_keypoints * 1.3 AS x, CAST(floor(laplacian_var) % 480 AS DOUBLE) AS y FROM scan_v)"


@query(
    "feature_distribution",
    "frame:l points:l score:d uniformity:d",
    with_views(
        _POINT_SQL
        + """, c AS (SELECT frame, least(floor(x / 160), 3) * 4 + least(floor(y / 120), 3) AS cell, count(*) AS n FROM pts WHERE x BETWEEN 0 AND 640 GROUP BY ALL),
        e AS (SELECT frame, sum(n) AS points, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY frame),
        q AS (SELECT frame, CAST(x >= 320 AS INT) * 2 + CAST(y >= 240 AS INT) AS cell, count(*) AS n FROM pts GROUP BY ALL),
        u AS (SELECT frame, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM q GROUP BY frame)
        SELECT e.frame, points, e.h / ln(16) AS score, u.h / ln(4) AS uniformity FROM e JOIN u USING (frame)"""
    ),
)
def _feature_distribution(spark, sf):
    p = written_table(_points(spark, sf), "points")
    u = G.feature_uniformity(p, ["frame"], 640, 480).select("frame", F.col("score").alias("uniformity"))
    return G.feature_distribution(p, ["frame"], 640, 480).join(u, "frame")


@query(
    "ray_dispersion",
    "frame:l points:l dispersion:d",
    with_views(
        _POINT_SQL
        + """, r AS (SELECT frame, nx / l AS a, ny / l AS b, 1 / l AS c FROM (SELECT *, sqrt(nx * nx + ny * ny + 1) + 1e-6 AS l FROM (
          SELECT frame, 2 * x / 640 - 1 AS nx, 2 * y / 480 - 1 AS ny FROM pts) q1) q2),
        v AS (SELECT frame, count(*) AS points, covar_samp(a, a) AS aa, covar_samp(b, b) AS bb, covar_samp(c, c) AS cc,
          covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, covar_samp(b, c) AS bc FROM r GROUP BY frame),
        s AS (SELECT *, (aa + bb + cc) / 3 AS q FROM v),
        t AS (SELECT *, sqrt(((aa-q)**2 + (bb-q)**2 + (cc-q)**2 + 2 * (ab*ab + ac*ac + bc*bc)) / 6) AS p FROM s),
        w AS (SELECT *, acos(least(greatest(((aa-q)*((bb-q)*(cc-q) - bc*bc) - ab*(ab*(cc-q) - bc*ac) + ac*(ab*bc - (bb-q)*ac)) / (2 * p**3), -1), 1)) / 3 AS f FROM t)
        SELECT frame, points, round(CASE WHEN points < 4 OR q + 2 * p * cos(f) < 1e-6 THEN 0
          ELSE least(greatest((q + 2 * p * cos(f + 2 * pi() / 3)) / (q + 2 * p * cos(f)), 0), 1) END, 4) AS dispersion FROM w"""
    ),
)
def _ray_dispersion(spark, sf):
    # The angle of the eigenvalues costs some digits of the covariances.
    out = G.ray_dispersion(_points(spark, sf), ["frame"], 640, 480)
    return out.withColumn("dispersion", F.round("dispersion", 4))


_BOXES = "SELECT s_suppkey AS frame, n * 200.0 AS x1, n * 200.0 + s_acctbal / 100.0 + 10 AS x2, n * 100.0 AS y1, n * 100.0 + 150 AS y2 FROM supplier"


@query(
    "points_in_boxes",
    "frame:l kept:l removed:l seam_points:l",
    with_views(
        _POINT_SQL
        + f""", box AS ({_BOXES}, (SELECT unnest(range(3)) AS n) k),
        f AS (SELECT *, EXISTS (SELECT 1 FROM box b WHERE b.frame = pts.frame AND x >= x1 AND x < x2 AND y >= y1 AND y < y2) AS hit,
          floor(x) < 8 OR (floor(x) >= 312 AND floor(x) < 328) OR (floor(x) >= 631 AND floor(x) < 640) AS seam FROM pts)
        SELECT frame, count(*) FILTER (NOT hit) AS kept, count(*) FILTER (hit) AS removed, count(*) FILTER (seam) AS seam_points FROM f GROUP BY frame"""
    ),
)
def _points_in_boxes(spark, sf):
    p = written_table(_points(spark, sf), "points")
    boxes = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("frame"), "s_acctbal", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    )
    boxes = boxes.selectExpr(
        "frame", "n * 200.0D AS x1", "n * 200.0D + s_acctbal / 100.0D + 10 AS x2", "n * 100.0D AS y1", "n * 100.0D + 150 AS y2"
    )
    n = lambda df, c: df.groupBy("frame").agg(F.count(F.lit(1)).alias(c))
    out = G.seam_count(p, ["frame"], 640)
    for keep, c in ((False, "kept"), (True, "removed")):
        out = out.join(n(G.points_in_boxes(p, boxes, ["frame"], keep=keep), c), "frame", "left")
    return out.fillna(0, ["kept", "removed"])


_CLASS = "CASE k % 8 WHEN 0 THEN 'person' WHEN 1 THEN 'car' WHEN 2 THEN 'dog' WHEN 3 THEN 'chair' WHEN 4 THEN 'bicycle' WHEN 5 THEN 'kite' WHEN 6 THEN 'bus' ELSE 'cat' END"


@query(
    "detection_filter",
    "item:l class_name:s confidence:d picked:s",
    f"""WITH d AS (SELECT p_partkey AS item, {_CLASS.replace('k %', 'p_partkey %')} AS class_name, p_partkey % 100 / 100.0 AS confidence FROM part)
    SELECT *, 'vehicles' AS picked FROM d WHERE confidence >= 0.25 AND class_name IN ('car', 'bus', 'truck', 'kite')
    UNION ALL SELECT *, 'other' FROM d WHERE confidence >= 0.5 AND class_name IN ('person', 'chair', 'kite')""",
)
def _detection_filter(spark, sf):
    k = F.col("p_partkey")
    d = V.table(spark, sf, "part").select(
        k.alias("item"), F.expr(_CLASS.replace("k %", "p_partkey %")).alias("class_name"), (k % 100 / 100.0).alias("confidence")
    )
    a = G.detection_filter(d, ["車両", "kite"]).withColumn("picked", F.lit("vehicles"))
    b = G.detection_filter(d, ["人", "その他"], min_confidence=0.5).withColumn("picked", F.lit("other"))
    return a.unionByName(b)


@query(
    "coverage_map",
    "video_id:l grid_row:l grid_col:l coverage:d",
    with_views(
        """, g AS (SELECT r AS grid_row, c AS grid_col, pi() / 2 - r * pi() / 8 AS phi, -pi() + c * 2 * pi() / 15 AS theta
          FROM (SELECT unnest(range(9)) AS r) a, (SELECT unnest(range(16)) AS c) b),
        p AS (SELECT video_id, cos(radians(pitch)) * cos(radians(yaw)) AS x, sin(radians(pitch)) AS y, cos(radians(pitch)) * sin(radians(yaw)) AS z FROM rows_v),
        w AS (SELECT video_id, grid_row, grid_col, cos(phi) * cos(theta) * x + sin(phi) * y + cos(phi) * sin(theta) * z AS ca FROM p, g)
        SELECT video_id, grid_row, grid_col, least(sum(CASE WHEN ca >= cos(pi() / 4) THEN exp(-4 * (acos(least(greatest(ca, -1), 1)) / (pi() / 4)) ** 2) ELSE 0 END)
          / count(*), 1) AS coverage FROM w GROUP BY ALL"""
    ),
)
def _coverage_map(spark, sf):
    return G.coverage_map(V.rows(spark, sf).select("video_id", "yaw", "pitch"), ["video_id"], 16, 9)


@query(
    "line_straightness",
    "pair_id:l full_before:d full_after:d full_ratio:d center_before:d center_after:d center_ratio:d",
    f"""WITH {_MATCH_SQL}, s AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len,
        ((x1 + x2) / 2 - 320) ** 2 + ((y1 + y2) / 2 - 240) ** 2 <= 2500 AS mid FROM matches),
      t AS (SELECT pair_id, coalesce(sum(len) FILTER (status = 1), 0) AS full_before, coalesce(sum(len) FILTER (status = 0), 0) AS full_after,
        coalesce(sum(len) FILTER (status = 1 AND mid), 0) AS center_before, coalesce(sum(len) FILTER (status = 0 AND mid), 0) AS center_after FROM s GROUP BY pair_id)
    SELECT *, CASE WHEN full_before <= 1e-9 THEN CASE WHEN full_after <= 1e-9 THEN 0 ELSE 999 END ELSE full_after / full_before END AS full_ratio,
      CASE WHEN center_before <= 1e-9 THEN CASE WHEN center_after <= 1e-9 THEN 0 ELSE 999 END ELSE center_after / center_before END AS center_ratio FROM t""",
)
def _line_straightness(spark, sf):
    seg = _matches(spark, sf).withColumn("stage", F.when(F.col("status") == 1, "before").otherwise("after"))
    return G.line_straightness(seg, ["pair_id"], 320.0, 240.0, 50.0)


@query(
    "descriptor_match",
    "frame_a:l frame_b:l point_a:l distance:l point_b:l",
    """WITH d AS (SELECT label AS frame, vec_id AS point_id, embedding AS e FROM embeddings),
      x AS (SELECT a.frame AS frame_a, b.frame AS frame_b, a.point_id AS point_a, b.point_id AS point_b,
        len(list_filter(range(1, 65), lambda i: (a.e[i] > 0) <> (b.e[i] > 0))) AS dist FROM d a JOIN d b ON b.frame = a.frame + 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY frame_a, point_a ORDER BY dist, point_b) AS k, lead(dist) OVER
        (PARTITION BY frame_a, point_a ORDER BY dist, point_b) AS d2 FROM x)
    SELECT frame_a, frame_b, point_a, dist AS distance, point_b FROM r WHERE k = 1 AND d2 IS NOT NULL AND dist < 0.95 * d2""",
)
def _descriptor_match(spark, sf):
    d = V.table(spark, sf, "embeddings").select(
        F.col("label").alias("frame"), F.col("vec_id").alias("point_id"), P.sign_descriptor("embedding").alias("bits")
    )
    pairs = d.select(F.col("frame").alias("frame_a"), (F.col("frame") + 1).alias("frame_b")).distinct()
    return P.descriptor_match(d, pairs, ratio=0.95, chunk=128)


# ---- pose and camera expressions --------------------------------------------


@query(
    "pose_math",
    "video_id:l frame_index:l m0:d m5:d angle:d w:d z:d ypr_angle:d",
    with_views(
        """, q AS (SELECT video_id, frame_index, yaw, pitch, rotation_delta, a / n AS w, b / n AS x, c / n AS y, d / n AS z FROM (
          SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM (SELECT *, 0.3 + k / 50 AS a, flow_mag / 30 - 1 AS b, score - 0.6 AS c, 0.2 - k / 300 AS d
          FROM (SELECT *, orb_keypoints AS k FROM rows_v) q0) q1) q2),
        r AS (SELECT *, 1 - 2 * (y * y + z * z) AS m0, 2 * (y * z - x * w) AS m5, CASE WHEN 4 * w * w > 1 THEN sign(w) WHEN x * x > y * y AND x * x > z * z THEN sign(x)
          WHEN y * y > z * z THEN sign(y) ELSE sign(z) END AS s, radians(yaw) AS a, radians(pitch) AS b, radians(rotation_delta) AS c FROM q)
        SELECT video_id, frame_index, m0, m5, degrees(acos(least(greatest((4 * w * w - 1 - 1) / 2, -1), 1))) AS angle, w * s AS w, z * s AS z,
          degrees(acos(least(greatest((cos(c) * cos(a) + cos(c) * cos(b) + sin(c) * sin(a) * sin(b) + cos(a) * cos(b) - 1) / 2, -1), 1))) AS ypr_angle FROM r"""
    ),
)
def _pose_math(spark, sf):
    df = V.rows(spark, sf).withColumn(
        "q",
        F.array(
            *[F.expr(e).cast("double") for e in ("0.3 + orb_keypoints / 50", "flow_mag / 30 - 1", "score - 0.6", "0.2 - orb_keypoints / 300")]
        ),
    )
    df = df.withColumn("m", Po.matrix_from_quaternion("q")).withColumn("back", Po.quaternion_from_matrix("m"))
    return df.select(
        "video_id",
        "frame_index",
        F.col("m")[0].alias("m0"),
        F.col("m")[5].alias("m5"),
        Po.rotation_degrees("m").alias("angle"),
        F.col("back")[0].alias("w"),
        F.col("back")[3].alias("z"),
        Po.rotation_degrees(Po.matrix_from_ypr("yaw", "pitch", "rotation_delta")).alias("ypr_angle"),
    )


@query(
    "pixel_direction",
    "video_id:l frame_index:l dx:d dy:d dz:d",
    with_views(
        """, a AS (SELECT video_id, frame_index, orb_keypoints * 10 / 1000.0 * 2 * pi() - pi() AS t, (250.0 - laplacian_var) / 500.0 * pi() - pi() / 2 AS p FROM rows_v),
        d AS (SELECT *, cos(p) * cos(t) AS x, sin(p) AS y, cos(p) * sin(t) AS z FROM a)
        SELECT video_id, frame_index, x / (sqrt(x*x + y*y + z*z) + 1e-8) AS dx, y / (sqrt(x*x + y*y + z*z) + 1e-8) AS dy,
          z / (sqrt(x*x + y*y + z*z) + 1e-8) AS dz FROM d"""
    ),
)
def _pixel_direction(spark, sf):
    d = Po.pixel_direction(F.col("orb_keypoints") * 10, "laplacian_var", 1000, 500)
    df = V.rows(spark, sf).withColumn("d", d)
    return df.select("video_id", "frame_index", *[F.col("d")[i].alias(c) for i, c in enumerate(("dx", "dy", "dz"))])


@query(
    "intrinsics_at_scale",
    "camera:l fx:d fy:d cx:d cy:d ex:d ecy:d",
    """WITH c AS (SELECT p_partkey AS camera, 640 + p_partkey % 40 * 100 AS w, 480 + p_partkey % 30 * 100 AS h, p_partkey % 3 <> 0 AS known FROM part),
      s AS (SELECT *, CASE WHEN greatest(w, h) <= 1000 THEN 1.0 ELSE 1000.0 / greatest(w, h) END AS s FROM c),
      z AS (SELECT *, greatest(1, round_even(w * s, 0)) AS nw, greatest(1, round_even(h * s, 0)) AS nh FROM s)
    SELECT camera, CASE WHEN known THEN (500 + camera % 50) * s ELSE greatest(nw, nh) END AS fx,
      CASE WHEN known THEN (505 + camera % 50) * s ELSE greatest(nw, nh) END AS fy, CASE WHEN known THEN w / 2.0 * s ELSE nw / 2 END AS cx,
      CASE WHEN known THEN h / 2.0 * s ELSE nh / 2 END AS cy, CASE WHEN known THEN 500 + camera % 50 ELSE greatest(w, h) / 2.0 END AS ex, h / 2.0 AS ecy FROM z""",
)
def _intrinsics_at_scale(spark, sf):
    k = F.col("p_partkey")
    c = V.table(spark, sf, "part").select(
        k.alias("camera"), (640 + k % 40 * 100).alias("w"), (480 + k % 30 * 100).alias("h"), (k % 3 != 0).alias("known")
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    f = (500 + F.col("camera") % 50).cast("double")
    mat = F.array(f, zero, F.col("w") / 2.0, zero, f + 5, F.col("h") / 2.0, zero, zero, one)
    c = c.withColumn("k", F.when(F.col("known"), mat))
    small = Po.scaled_intrinsics("k", F.col("w"), F.col("h"))
    full = Po.export_intrinsics("k", F.col("w"), F.col("h"))
    return c.select("camera", *[small[i].alias(n) for i, n in enumerate(("fx", "fy", "cx", "cy"))], full[0].alias("ex"), full[3].alias("ecy"))
