"""Queries over pixels: metrics, masks and reprojections of the grey frames."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from reelframe.catalogue import views as V
from reelframe.catalogue.base import query
from reelframe.catalogue.views import with_views
from reelframe.functions import kernels as N
from reelframe.functions.projections import CUBE_FACES, cross5_views
from reelframe.operators import masks as M
from reelframe.operators import packed_masks as PM
from reelframe.operators import pixel_tables as T
from reelframe.operators import pixels as P
from reelframe.operators import reproject as R
from reelframe.operators.pairs import consecutive_pairs

FRAME = ["video_id", "frame_index"]


# ---- SQL building blocks: a frame as a list of pixels in row order ----------


def _at(dy: int, dx: int, n: int = 8) -> str:
    """Neighbour of pixel (y, x) in list ``l`` of an n x n frame, mirrored at the border."""

    def axis(c: str, d: int) -> str:
        if d == 0:
            return c
        return f"(CASE WHEN {c} + ({d}) < 0 THEN -({c} + ({d})) WHEN {c} + ({d}) > {n - 1} THEN {2 * n - 2} - ({c} + ({d})) ELSE {c} + ({d}) END)"

    return f"l[{axis('y', dy)} * {n} + {axis('x', dx)} + 1]"


def _grad_cte(src: str, n: int, name: str = "grad") -> str:
    right = f"{_at(-1, 1, n)} + 2 * {_at(0, 1, n)} + {_at(1, 1, n)}"
    left = f"{_at(-1, -1, n)} + 2 * {_at(0, -1, n)} + {_at(1, -1, n)}"
    below = f"{_at(1, -1, n)} + 2 * {_at(1, 0, n)} + {_at(1, 1, n)}"
    above = f"{_at(-1, -1, n)} + 2 * {_at(-1, 0, n)} + {_at(-1, 1, n)}"
    return f"""{name}_l AS (SELECT video_id, frame_index, list(v ORDER BY y, x) AS l FROM {src} GROUP BY ALL),
      {name} AS (SELECT p.*, {_at(-1, 0, n)} + {_at(1, 0, n)} + {_at(0, -1, n)} + {_at(0, 1, n)} - 4 * v AS lap,
        ({right}) - ({left}) AS gx, ({below}) - ({above}) AS gy FROM {src} p JOIN {name}_l USING (video_id, frame_index))"""


_RAW_SQL = with_views(
    ", "
    + _grad_cte("pixels_v", 8)
    + """, roi AS (SELECT * FROM grad WHERE (x - 4) * (x - 4) + (y - 4) * (y - 4) <= 4),
    a AS (SELECT video_id, frame_index, var_pop(lap) AS laplacian_var, avg(gx * gx + gy * gy) AS tenengrad,
      avg(CASE WHEN v <= 16 THEN 1.0 ELSE 0.0 END) AS black_clip, avg(CASE WHEN v >= 245 THEN 1.0 ELSE 0.0 END) AS white_clip,
      stddev_pop(v) AS contrast, count(*) AS roi_pixel_count FROM roi GROUP BY ALL)
    SELECT *, 0.7 * least(contrast / 64, 1) + 0.3 * (1 - least(black_clip + white_clip, 1)) AS exposure_roi FROM a"""
)
_RAW_COLS = "video_id:l frame_index:l laplacian_var:d tenengrad:d black_clip:d white_clip:d contrast:d exposure_roi:d roi_pixel_count:l"


@query("raw_quality", _RAW_COLS, _RAW_SQL)
def _raw_quality(spark, sf):
    return P.raw_quality(V.images(spark, sf), FRAME)


@query("raw_quality_table", _RAW_COLS, _RAW_SQL)
def _raw_quality_table(spark, sf):
    return T.raw_quality_table(V.pixels(spark, sf), FRAME, 8, 8)


@query(
    "roi_mask",
    "video_id:l frame_index:l circle_sum:d rect_sum:d circle_pixels:l rect_pixels:l",
    with_views(
        """SELECT video_id, frame_index, sum(v) FILTER ((x - 4) * (x - 4) + (y - 4) * (y - 4) <= 9) AS circle_sum,
        sum(v) FILTER (x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 5) AS rect_sum,
        count(*) FILTER ((x - 4) * (x - 4) + (y - 4) * (y - 4) <= 9) AS circle_pixels,
        count(*) FILTER (x BETWEEN 1 AND 5 AND y BETWEEN 1 AND 5) AS rect_pixels FROM pixels_v GROUP BY ALL"""
    ),
)
def _roi_mask(spark, sf):
    circle, rect = T.roi_predicate(8, 8, "circle", 0.7), T.roi_predicate(8, 8, "rect", 0.6)
    return V.pixels(spark, sf).groupBy(*FRAME).agg(
        F.sum(F.when(circle, F.col("v"))).alias("circle_sum"),
        F.sum(F.when(rect, F.col("v"))).alias("rect_sum"),
        F.count_if(circle).alias("circle_pixels"),
        F.count_if(rect).alias("rect_pixels"),
    )


_HALF = """half_v AS (SELECT video_id, frame_index, y // 2 AS y, x // 2 AS x, floor(avg(v) + 0.5) AS v FROM pixels_v GROUP BY ALL)"""


def _legacy_sql(src: str, n: int, prefix: str) -> str:
    return with_views(
        f"""{prefix}, {_grad_cte(src, n)},
        m AS (SELECT *, sqrt(gx * gx + gy * gy) AS mag, least(floor(fmod(atan2(gy, gx) + pi(), pi()) / pi() * 18), 17) AS cell FROM grad),
        b AS (SELECT video_id, frame_index, var_pop(lap) AS sharpness, sum(abs(gx)) AS ex, sum(abs(gy)) AS ey, max(mag) AS peak,
          sum(mag) AS total, avg(v) AS bright FROM m GROUP BY ALL),
        c AS (SELECT video_id, frame_index, cell, sum(mag) AS h FROM m GROUP BY ALL),
        e AS (SELECT video_id, frame_index, sum(CASE WHEN h > 0 THEN -(h / total) * log2(h / total) ELSE 0 END) AS entropy
          FROM c JOIN b USING (video_id, frame_index) GROUP BY ALL),
        d AS (SELECT video_id, frame_index, sum(w * w * exp(5 * (w - 1))) / sum(w * exp(5 * (w - 1))) AS depth FROM (
          SELECT video_id, frame_index, mag / peak AS w FROM m JOIN b USING (video_id, frame_index)) q WHERE w > 0.01 GROUP BY ALL)
        SELECT video_id, frame_index, sharpness, abs(ex / (ex + ey) - 0.5) * 2 AS imbalance, 1 - entropy / log2(18) AS angle_score,
          log2(1 + depth) AS softmax_depth, exp(-((bright - 128) ** 2) / (2.0 * 80 * 80)) AS exposure_gauss
        FROM b JOIN e USING (video_id, frame_index) JOIN d USING (video_id, frame_index)"""
    )


@query(
    "legacy_quality",
    "video_id:l frame_index:l sharpness:d motion_blur:d exposure_gauss:d softmax_depth:d",
    "SELECT video_id, frame_index, sharpness, imbalance AS motion_blur, exposure_gauss, softmax_depth FROM ("
    + _legacy_sql("half_v", 4, ", " + _HALF + " /* pixels_v */")
    + ") q",
)
def _legacy_quality(spark, sf):
    return P.legacy_quality(V.images(spark, sf), FRAME)


@query(
    "motion_blur",
    "video_id:l frame_index:l sharpness:d imbalance:d angle_score:d softmax_depth:d exposure_gauss:d",
    _legacy_sql("pixels_v", 8, ""),
)
def _motion_blur(spark, sf):
    return T.blur_and_depth(V.pixels(spark, sf), FRAME, 8, 8)


@query(
    "motion_blur_hybrid",
    "video_id:l frame_index:l motion_blur:d",
    "SELECT video_id, frame_index, 0.25 * imbalance + 0.35 * angle_score AS motion_blur FROM (" + _legacy_sql("pixels_v", 8, "") + ") q",
)
def _motion_blur_hybrid(spark, sf):
    # Quadrants of 8 x 8 frames are too small for a spectrum, so that part is 0 here.
    return P.legacy_quality(V.images(spark, sf), FRAME, scale=1.0, method="fft_hybrid")


@query(
    "softmax_depth",
    "video_id:l frame_index:l softmax_depth:d",
    "SELECT video_id, frame_index, softmax_depth FROM (" + _legacy_sql("half_v", 4, ", " + _HALF + " /* pixels_v */") + ") q",
)
def _softmax_depth(spark, sf):
    return T.blur_and_depth(T.half_scale(V.pixels(spark, sf), FRAME), FRAME, 4, 4)


def _weights_cte() -> str:
    m = N.blur_matrix(4)
    rows = ", ".join(f"({i}, {j}, {float(m[i, j])!r})" for i in range(4) for j in range(4))
    return f"wt AS (SELECT * FROM (VALUES {rows}) AS t(i, j, w))"


@query(
    "pair_ssim",
    "video_id:l ref_vec:l vec:l ssim:d",
    with_views(
        f""", {_HALF}, {_weights_cte()},
        prs AS (SELECT a.video_id, a.vec_id AS ref_vec, b.vec_id AS vec FROM sequence_v a JOIN sequence_v b
          ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1),
        px AS (SELECT p.*, h.y, h.x, h.v AS a, g.v AS b FROM prs p
          JOIN half_v h ON h.video_id = p.video_id AND h.frame_index = p.ref_vec
          JOIN half_v g ON g.video_id = p.video_id AND g.frame_index = p.vec AND g.y = h.y AND g.x = h.x),
        sm AS (SELECT video_id, ref_vec, vec, wy.i AS y, wx.i AS x, sum(wy.w * wx.w * a) AS ma, sum(wy.w * wx.w * b) AS mb,
          sum(wy.w * wx.w * a * a) AS saa, sum(wy.w * wx.w * b * b) AS sbb, sum(wy.w * wx.w * a * b) AS sab
          FROM px JOIN wt wy ON wy.j = px.y JOIN wt wx ON wx.j = px.x GROUP BY ALL)
        SELECT video_id, ref_vec, vec, avg((2 * ma * mb + 6.5025) * (2 * (sab - ma * mb) + 58.5225)
          / ((ma * ma + mb * mb + 6.5025) * (saa - ma * ma + sbb - mb * mb + 58.5225))) AS ssim FROM sm GROUP BY ALL"""
    ),
)
def _pair_ssim(spark, sf):
    seq = V.sequence(spark, sf)
    pairs = consecutive_pairs(seq, ["video_id"])
    name = lambda c, out: seq.select("video_id", F.col("frame_index").alias(c), F.col("vec_id").alias(out))
    pairs = pairs.join(name("ref_index", "ref_vec"), ["video_id", "ref_index"]).join(
        name("frame_index", "vec"), ["video_id", "frame_index"]
    )
    frames = V.images(spark, sf).withColumnRenamed("frame_index", "vec")
    return P.pair_ssim(pairs.select("video_id", "ref_vec", "vec"), frames, ["video_id"], ref="ref_vec", index="vec")


# ---- reprojection ----------------------------------------------------------


def _bilinear(maps: str, wrap: bool) -> str:
    """Sample pixels_v at the coordinates of ``maps`` (view, y, x, mx, my)."""
    inside = "true" if wrap else "sy BETWEEN 0 AND 7 AND sx BETWEEN 0 AND 7"
    return f""", maps AS ({maps}),
      taps AS (SELECT view, y, x, CAST(floor(my) AS BIGINT) + dy AS sy, CAST(floor(mx) AS BIGINT) + dx AS sx,
        (CASE dy WHEN 0 THEN 1 - (my - floor(my)) ELSE my - floor(my) END) * (CASE dx WHEN 0 THEN 1 - (mx - floor(mx)) ELSE mx - floor(mx) END) AS w
        FROM maps, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(dy, dx)),
      tap AS (SELECT view, y, x, sy % 8 AS sy, sx % 8 AS sx, w FROM taps WHERE w > 0 AND {inside})
      SELECT p.video_id, p.frame_index, tap.view, tap.y, tap.x, sum(p.v * tap.w) AS v
      FROM tap JOIN pixels_v p ON p.y = tap.sy AND p.x = tap.sx GROUP BY ALL"""


def _equirect_sql(directions: str) -> str:
    """Coordinates on the 8 x 8 equirectangular source for directions (view, y, x, dx, dy, dz)."""
    return f"""SELECT view, y, x,
      least(greatest(fmod((atan2(uz, ux) + pi()) / (2 * pi()) * 8 + 8, 8), 0), 6.999) AS mx,
      least(greatest((pi() / 2 - asin(least(greatest(uy, -1), 1))) / pi() * 8, 0), 6.999) AS my FROM (
      SELECT view, y, x, dx / n AS ux, dy / n AS uy, dz / n AS uz FROM (
        SELECT *, sqrt(dx * dx + dy * dy + dz * dz) + 1e-8 AS n FROM ({directions}) q1) q2) q3"""


def _grid(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS y) gy, (SELECT unnest(range({n})) AS x) gx"


def _cube_sql() -> str:
    lin = lambda c: f"(-1 + 2.0 * {c} / 4)"
    parts = []
    for face, (across, centre, down) in CUBE_FACES.items():
        d = [f"({a} * {lin('x')} + {b} + {c} * {lin('y')})" for a, b, c in zip(across, centre, down)]
        parts.append(f"SELECT '{face}' AS view, y, x, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM {_grid(5)}")
    return with_views(_bilinear(_equirect_sql(" UNION ALL ".join(parts)), True))


@query("reproject_cubemap", "video_id:l frame_index:l view:s y:l x:l v:d", _cube_sql())
def _reproject_cubemap(spark, sf):
    return T.reproject(V.pixels(spark, sf), R.cubemap_lookup(spark, 8, 8, 5), FRAME)


_VIEWS = [(f"yaw{y}_pitch{p}", float(y), float(p), 90.0) for y in (0, 120, -120) for p in (0, 30)]


def _perspective_sql() -> str:
    parts = []
    for name, yaw, pitch, fov in _VIEWS:
        a, b, f = math.radians(yaw), math.radians(pitch), 1.0 / math.tan(math.radians(fov) / 2)
        ca, sa, cb, sb = math.cos(a), math.sin(a), math.cos(b), math.sin(b)
        x, y = "(-1 + 2.0 * x / 3)", "(-1 + 2.0 * y / 3)"
        rx, rz = f"({x} * {ca!r} + {f * sa!r})", f"({f * ca!r} - {x} * {sa!r})"
        parts.append(
            f"SELECT '{name}' AS view, y, x, {rx} AS dx, ({y} * {cb!r} - {rz} * {sb!r}) AS dy, ({y} * {sb!r} + {rz} * {cb!r}) AS dz FROM {_grid(4)}"
        )
    return with_views(_bilinear(_equirect_sql(" UNION ALL ".join(parts)), True))


@query("reproject_perspective", "video_id:l frame_index:l view:s y:l x:l v:d", _perspective_sql())
def _reproject_perspective(spark, sf):
    return T.reproject(V.pixels(spark, sf), R.perspective_lookup(spark, 8, 8, _VIEWS, 4, 4), FRAME)


_FISHEYE_MAPS = f"""SELECT 'equirect' AS view, y, x,
    least(greatest(4 * u * bend + 4, 0), 7) AS mx, least(greatest(4 * w * bend + 4, 0), 7) AS my FROM (
    SELECT *, CASE WHEN sqrt(u * u + w * w) > 1e-8 THEN atan(sqrt(u * u + w * w)) / sqrt(u * u + w * w) ELSE 0 END AS bend FROM (
      SELECT y, x, cos(ph) * cos(th) AS dx, sin(ph) / greatest(cos(ph) * cos(th), 1e-8) AS w,
        cos(ph) * sin(th) / greatest(cos(ph) * cos(th), 1e-8) AS u FROM (
        SELECT y, x, -pi() + 2 * pi() * x / 9 AS th, pi() / 2 - pi() * y / 5 AS ph
        FROM (SELECT unnest(range(6)) AS y) gy, (SELECT unnest(range(10)) AS x) gx) g) q WHERE dx > 0) q2"""


@query("fisheye_to_equirect", "video_id:l frame_index:l view:s y:l x:l v:d", with_views(_bilinear(_FISHEYE_MAPS, False)))
def _fisheye_to_equirect(spark, sf):
    return T.reproject(V.pixels(spark, sf), R.fisheye_lookup(spark, 8, 8, 10, 6), FRAME)


_LENS_K = (3.1, 0.0, 3.6, 0.0, 3.0, 3.4, 0.0, 0.0, 1.0)
_LENS_D = (0.02, -0.01, 0.004, -0.001)


def _cross5_sql() -> str:
    f = 4 / (2.0 * math.tan(math.radians(80.0) / 2.0))
    parts = []
    for name, yaw, pitch in cross5_views():
        a, b = math.radians(yaw), math.radians(pitch)
        ry = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
        rx = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
        m = ry @ rx
        ray = [f"((x - 2) / {f!r})", f"((y - 2) / {f!r})", "1.0"]
        d = [" + ".join(f"{ray[i]} * {float(m[i, c])!r}" for i in range(3)) for c in range(3)]
        parts.append(f"SELECT '{name}' AS view, y, x, {d[0]} AS dx, {d[1]} AS dy, {d[2]} AS dz FROM {_grid(4)}")
    k, c = _LENS_K, _LENS_D
    maps = f"""SELECT view, y, x, {k[0]} * u * s + {k[2]} AS mx, {k[4]} * w * s + {k[5]} AS my FROM (
      SELECT *, CASE WHEN r > 1e-8 THEN atan(r) * (1 + {c[0]} * atan(r) ** 2 + {c[1]} * atan(r) ** 4 + {c[2]} * atan(r) ** 6 + {c[3]} * atan(r) ** 8) / r ELSE 1 END AS s
      FROM (SELECT view, y, x, dx / dz AS u, dy / dz AS w, sqrt(dx * dx + dy * dy) / dz AS r FROM ({' UNION ALL '.join(parts)}) q WHERE dz > 0) q2) q3"""
    return with_views(_bilinear(maps, False))


@query("split_cross5", "video_id:l frame_index:l view:s y:l x:l v:d", _cross5_sql())
def _split_cross5(spark, sf):
    return T.reproject(V.pixels(spark, sf), R.cross5_lookup(spark, 8, 8, _LENS_K, _LENS_D, 4), FRAME)


@query(
    "stitch_fast",
    "video_id:l frame_index:l y:l x:l v:l",
    with_views(
        """, prs AS (SELECT a.video_id, a.frame_index // 2 AS frame_index, a.vec_id AS va, b.vec_id AS vb FROM sequence_v a JOIN sequence_v b
          ON a.video_id = b.video_id AND b.frame_index = a.frame_index + 1 WHERE a.frame_index % 2 = 0)
        SELECT p.video_id, p.frame_index, q.y, q.x, CASE WHEN q.x = 7 THEN floor(q.v) ELSE q.v END AS v FROM prs p JOIN pixels_v q
          ON q.video_id = p.video_id AND q.frame_index = p.va
        UNION ALL SELECT p.video_id, p.frame_index, q.y, q.x + 7, q.v FROM prs p JOIN pixels_v q
          ON q.video_id = p.video_id AND q.frame_index = p.vb WHERE q.x > 0"""
    ),
)
def _stitch_fast(spark, sf):
    # With 8 columns the overlap is one column, whose weight starts at the left image.
    seq = V.sequence(spark, sf)
    img = V.images(spark, sf).withColumnRenamed("frame_index", "vec_id").join(seq, ["video_id", "vec_id"])
    lens = F.when(F.col("frame_index") % 2 == 0, "a").otherwise("b")
    both = img.withColumn("lens", lens).withColumn("frame_index", F.floor(F.col("frame_index") / 2))
    out = R.stitch_fast(R.paired_payloads(both, FRAME), FRAME)
    return P.explode_payload(out, FRAME)


# ---- masks -----------------------------------------------------------------


@query(
    "apply_region_mask",
    "video_id:l frame_index:l fisheye:d polar:d nadir:d zenith:d total_pixels:l masked_pixels:l mask_ratio:d",
    with_views(
        """SELECT video_id, frame_index,
        sum(CASE WHEN (x - 4) * (x - 4) + (y - 4) * (y - 4) <= 9 THEN v ELSE 7 END) AS fisheye,
        sum(CASE WHEN y < 2 OR y >= 6 THEN 7 ELSE v END) AS polar,
        sum(CASE WHEN (x - 4) * (x - 4) + (y - 6) * (y - 6) <= 4 THEN 7 ELSE v END) AS nadir,
        sum(CASE WHEN (x - 4) * (x - 4) + (y - 1) * (y - 1) <= 1 THEN 7 ELSE v END) AS zenith,
        count(*) AS total_pixels, count(*) FILTER (v > 128) AS masked_pixels, count(*) FILTER (v > 128) / count(*) AS mask_ratio
        FROM pixels_v GROUP BY ALL"""
    ),
)
def _apply_region_mask(spark, sf):
    px = V.pixels(spark, sf)
    ratios = {"fisheye": 0.94, "polar": 0.3, "nadir": 0.3, "zenith": 0.2}
    removed = {k: T.region_mask(8, 8, k, r) for k, r in ratios.items()}
    sums = px.groupBy(*FRAME).agg(*[F.sum(F.when(c, 7.0).otherwise(F.col("v"))).alias(k) for k, c in removed.items()])
    return sums.join(T.mask_stats(px.withColumn("masked", F.col("v") > 128), FRAME), FRAME)


@query(
    "mask_sets",
    "video_id:l frame_index:l n_both:l n_either:l",
    with_views(
        """SELECT video_id, frame_index, count(*) FILTER (v > 100 AND x > y) AS n_both,
        count(*) FILTER (v > 100 OR x > y) AS n_either FROM pixels_v GROUP BY ALL"""
    ),
)
def _mask_sets(spark, sf):
    px = V.pixels(spark, sf)
    a, b = px.filter("v > 100"), px.filter("x > y")
    n = lambda df, c: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(c))
    both, either = n(T.mask_intersect(a, b, FRAME), "n_both"), n(T.mask_union(a, b, FRAME), "n_either")
    return either.join(both, FRAME, "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))


def _ellipse_values() -> str:
    offsets = np.argwhere(N.ellipse(5)) - 2
    return "(VALUES " + ", ".join(f"({int(a)}, {int(b)})" for a, b in offsets) + ") AS o(dy, dx)"


def _morph_sql(src: str, fn: str) -> str:
    return f"""SELECT m.video_id, m.frame_index, m.y, m.x, {fn}(n.m) AS m FROM {src} m, {_ellipse_values()}
      JOIN {src} n ON n.video_id = m.video_id AND n.frame_index = m.frame_index AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY ALL"""


@query(
    "motion_mask",
    "video_id:l frame_index:l y:l x:l v:l",
    with_views(
        f""", h AS (SELECT s.video_id, s.frame_index, p.y, p.x, p.v AS c, lag(p.v) OVER w AS b, lag(p.v, 2) OVER w AS a
          FROM sequence_v s JOIN pixels_v p ON p.video_id = s.video_id AND p.frame_index = s.vec_id
          WINDOW w AS (PARTITION BY s.video_id, p.y, p.x ORDER BY s.frame_index)),
        m0 AS (SELECT video_id, frame_index, y, x, CASE WHEN a IS NULL THEN CAST(abs(c - b) > 150 AS INT)
          ELSE CAST(abs(b - a) > 150 OR abs(c - (0.7 * a + 0.3 * b)) > 150 AS INT) END AS m FROM h WHERE b IS NOT NULL),
        m1 AS ({_morph_sql('m0', 'min')}), m2 AS ({_morph_sql('m1', 'max')}),
        m3 AS ({_morph_sql('m2', 'max')}), m4 AS ({_morph_sql('m3', 'min')})
        SELECT video_id, frame_index, y, x, m AS v FROM m4"""
    ),
)
def _motion_mask(spark, sf):
    img = V.images(spark, sf).withColumnRenamed("frame_index", "vec_id")
    frames = img.join(V.sequence(spark, sf), ["video_id", "vec_id"])
    return P.explode_payload(M.motion_mask(frames, ["video_id"], history=3, threshold=150.0), FRAME)


@query(
    "detections_to_mask",
    "video_id:l frame_index:l y:l x:l mask:l",
    with_views(
        """, box AS (SELECT video_id, frame_index, greatest(0, least(7, CAST(trunc(v / 40 - 1) AS INT))) AS x1,
          greatest(0, least(8, CAST(trunc(v / 40 + 2) AS INT))) AS x2, greatest(0, least(7, y)) AS y1, greatest(0, least(8, y + 2)) AS y2
          FROM pixels_v WHERE x = 3 AND v > 90)
        SELECT p.video_id, p.frame_index, p.y, p.x, CASE WHEN EXISTS (SELECT 1 FROM box b WHERE b.video_id = p.video_id
          AND b.frame_index = p.frame_index AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2) THEN 0 ELSE 255 END AS mask FROM pixels_v p"""
    ),
)
def _detections_to_mask(spark, sf):
    px = V.pixels(spark, sf)
    boxes = px.filter("x = 3 AND v > 90").select(
        *FRAME,
        (F.col("v") / 40 - 1).alias("x1"),
        (F.col("v") / 40 + 2).alias("x2"),
        F.col("y").alias("y1"),
        (F.col("y") + 2).alias("y2"),
    )
    return M.detections_to_mask(px, boxes, FRAME, 8, 8)


# ---- packed masks of 64 x 64 frames -----------------------------------------


@query(
    "packed_region_masks",
    "video_id:l frame_index:l fisheye:d polar:d nadir:d zenith:d total_pixels:l masked_pixels:l mask_ratio:d",
    with_views(
        """SELECT video_id, frame_index,
        sum(CASE WHEN (x - 32) * (x - 32) + (y - 32) * (y - 32) <= 900 THEN v ELSE 7 END) AS fisheye,
        sum(CASE WHEN y < 6 OR y >= 58 THEN 7 ELSE v END) AS polar,
        sum(CASE WHEN (x - 32) * (x - 32) + (y - 55) * (y - 55) <= 81 THEN 7 ELSE v END) AS nadir,
        sum(CASE WHEN (x - 32) * (x - 32) + (y - 3) * (y - 3) <= 9 THEN 7 ELSE v END) AS zenith,
        count(*) AS total_pixels, count(*) FILTER (v > 128) AS masked_pixels, count(*) FILTER (v > 128) / count(*) AS mask_ratio
        FROM large_v GROUP BY ALL"""
    ),
)
def _packed_region_masks(spark, sf):
    img = V.large_images(spark, sf)
    total = lambda df, name: P.frame_job(df, FRAME, lambda a: {name: float(a.sum())}, [name])
    out = PM.mask_stats(PM.mask_where(img, FRAME, lambda a: a > 128), FRAME)
    for kind in ("polar", "nadir", "zenith"):
        out = out.join(total(PM.fill_region(img, FRAME, kind, fill=7), kind), FRAME)
    lens = PM.region_masks(img, FRAME, "fisheye")
    return out.join(total(PM.fill_masked(img, lens, FRAME, fill=7), "fisheye"), FRAME)


@query(
    "packed_mask_sets",
    "video_id:l frame_index:l n_both:l n_either:l n_first:l sum_y:l sum_x:l",
    with_views(
        """SELECT video_id, frame_index, count(*) FILTER (v > 100 AND x > y) AS n_both, count(*) FILTER (v > 100 OR x > y) AS n_either,
        count(*) FILTER (v > 100 AND x <= y) AS n_first, coalesce(sum(y) FILTER (v > 100 AND x <= y), 0) AS sum_y,
        coalesce(sum(x) FILTER (v > 100 AND x <= y), 0) AS sum_x FROM large_v GROUP BY ALL"""
    ),
)
def _packed_mask_sets(spark, sf):
    img = V.large_images(spark, sf)
    a = PM.mask_where(img, FRAME, lambda v: v > 100)
    b = PM.mask_where(img, FRAME, lambda v: np.arange(v.shape[1]) > np.arange(v.shape[0])[:, None])
    n = lambda how, name: PM.mask_stats(PM.combine(a, b, FRAME, how), FRAME).withColumnRenamed("masked_pixels", name)
    both, either = n("and", "n_both").select(*FRAME, "n_both"), n("or", "n_either").select(*FRAME, "n_either")
    return n("minus", "n_first").join(both, FRAME).join(either, FRAME)


@query(
    "packed_box_masks",
    "video_id:l frame_index:l masked_pixels:l sum_y:l sum_x:l",
    with_views(
        """, box AS (SELECT video_id, frame_index, greatest(0, least(63, CAST(trunc(v / 4 - 3) AS INT))) AS x1,
          greatest(0, least(64, CAST(trunc(v / 4 + 9.5) AS INT))) AS x2, y * 8 AS y1, greatest(0, least(64, CAST(trunc(y * 8 + v / 20) AS INT))) AS y2
          FROM pixels_v WHERE x = 0 AND v > 120),
        hit AS (SELECT p.*, EXISTS (SELECT 1 FROM box b WHERE b.video_id = p.video_id AND b.frame_index = p.frame_index
          AND p.x >= x1 AND p.x < x2 AND p.y >= y1 AND p.y < y2) AS m FROM large_v p)
        SELECT video_id, frame_index, count(*) FILTER (m) AS masked_pixels, coalesce(sum(y) FILTER (m), 0) AS sum_y,
          coalesce(sum(x) FILTER (m), 0) AS sum_x FROM hit GROUP BY ALL"""
    ),
)
def _packed_box_masks(spark, sf):
    v, y = F.col("v"), F.col("y") * 8
    boxes = V.pixels(spark, sf).filter("x = 0 AND v > 120").select(
        *FRAME, (v / 4 - 3).alias("x1"), (v / 4 + 9.5).alias("x2"), y.alias("y1"), (y + v / 20).alias("y2")
    )
    return PM.mask_stats(PM.box_masks(boxes, V.large_images(spark, sf).select(*FRAME, "height", "width"), FRAME), FRAME)
