"""Match residuals, model choice and feature statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.common import clip
from reelframe.functions.pose import view_direction
from reelframe.plans.blocks import attach
from reelframe.plans.percentiles import exact_percentiles

INF = float("inf")


def _apply(m: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    return tuple(m[3 * r] * x + m[3 * r + 1] * y + m[3 * r + 2] for r in range(3))


def _safe(c: Column) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(INF)), F.lit(INF))


def inverse(m: Column) -> Column:
    """Inverse of a 3x3 matrix by cofactors; null if singular."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cof = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return F.when(det != 0, F.array(*[x / det for x in cof]))


def homography_error(h: Column, h_inv: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Mean of the squared forward and backward transfer errors."""

    def transfer(m: Column, xa: Column, ya: Column, xb: Column, yb: Column) -> Column:
        u, v, w = _apply(m, xa, ya)
        w = F.when(F.abs(w) < 1e-10, 1e-10).otherwise(w)
        return _safe((u / w - xb) ** 2 + (v / w - yb) ** 2)

    forward = transfer(h, x1, y1, x2, y2)
    backward = F.when(h_inv.isNull(), forward).otherwise(transfer(h_inv, x2, y2, x1, y1))
    return (forward + backward) / 2.0


def sampson_error(f: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared Sampson distance to the epipolar constraint."""
    a = _apply(f, x1, y1)
    t = [f[c] * x2 + f[3 + c] * y2 + f[6 + c] for c in range(3)]
    top = x2 * a[0] + y2 * a[1] + a[2]
    low = F.greatest(a[0] ** 2 + a[1] ** 2 + t[0] ** 2 + t[1] ** 2, F.lit(1e-10))
    return _safe(top * top / low)


def model_residuals(matches: DataFrame, models: DataFrame, pair: Sequence[str], spread: str = "match_id") -> DataFrame:
    """Add ``err_h`` and ``err_f`` to each match; models carry ``h`` and ``f`` per pair."""
    out = attach(matches, models.withColumn("h_inv", inverse(F.col("h"))), pair, F.col(spread), how="inner")
    p = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    return out.withColumn("err_h", homography_error(F.col("h"), F.col("h_inv"), *p)).withColumn(
        "err_f", sampson_error(F.col("f"), *p)
    ).drop("h", "f", "h_inv")


# Fixed values: (dimension, parameters) of the two models, data dimension 4.
MODELS = {"h": (2, 8), "f": (3, 7)}


def gric(residuals: DataFrame, pair: Sequence[str], *, sigma: float = 1.0, lambda1: float = 2.0, lambda2: float = 4.0) -> DataFrame:
    """Robust information criterion per pair: ``gric_h``, ``gric_f``, ``n``."""
    s2 = max(sigma * sigma, 1e-10)
    n = F.count(F.lit(1))

    def score(m: str) -> Column:
        d, k = MODELS[m]
        return F.sum(F.least(F.col(f"err_{m}") / s2, F.lit(2.0 * (4 - d)))) + lambda1 * d * n + lambda2 * k

    return residuals.groupBy(*pair).agg(
        score("h").alias("gric_h"),
        score("f").alias("gric_f"),
        n.alias("n"),
        F.avg(F.col("inlier_h").cast("double")).alias("ratio_h"),
        F.avg(F.col("inlier_f").cast("double")).alias("ratio_f"),
    )


def gric_decision(
    scores: DataFrame, *, min_matches: int = 15, min_inlier: float = 0.3, degenerate: float = 0.85
) -> DataFrame:
    """``status`` and ``score`` per pair; failures keep fallback scores instead of raising."""
    total = F.col("gric_h") + F.col("gric_f") + 1e-10
    lead = F.abs(F.col("gric_h") - F.col("gric_f")) / total
    parallax = F.col("gric_f") < F.col("gric_h")
    raw = F.when(parallax, clip(0.5 + lead, 0.3, 1.0)).otherwise(clip(0.5 - lead, 0.0, 0.5))
    status = (
        F.when(F.col("n") < min_matches, "insufficient_features")
        .when((F.col("ratio_h") < min_inlier) & (F.col("ratio_f") < min_inlier), "estimation_failure")
        .when(F.col("ratio_h") >= degenerate, "degenerate")
        .when(~parallax & (raw < 0.15), "degenerate")
        .otherwise("ok")
    )
    score = F.when(status == "ok", raw).when(status == "degenerate", 0.1).otherwise(0.05)
    return scores.withColumn("status", status).withColumn("score", score)


def _entropy(df: DataFrame, keys: Sequence[str], cell: Column, cells: int) -> DataFrame:
    counts = df.withColumn("_cell", cell).filter(F.col("_cell").isNotNull()).groupBy(*keys, "_cell").count()
    total = F.sum("count")
    # sum p ln p = (sum n ln n) / N - ln N
    h = F.log(total) - F.sum(F.col("count") * F.log("count")) / total
    return counts.groupBy(*keys).agg(total.alias("points"), clip(h / math.log(cells), 0.0, 1.0).alias("score"))


def feature_distribution(points: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Evenness of key points over a 4x4 grid; the far edges belong to the last cells."""
    axis = lambda c, size: F.when(
        F.col(c).between(0, size), F.least(F.floor(F.col(c) / (size / 4.0)), F.lit(3))
    )
    return _entropy(points, keys, axis("x", width) * 4 + axis("y", height), 16)


def feature_uniformity(points: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Evenness of points over the four quadrants."""
    cell = (F.col("x") >= width * 0.5).cast("int") * 2 + (F.col("y") >= height * 0.5).cast("int")
    return _entropy(points, keys, cell, 4)


def ray_dispersion(
    points: DataFrame, keys: Sequence[str], width: int, height: int, *, equirect: bool = False
) -> DataFrame:
    """Smallest over largest eigenvalue of the covariance of all viewing rays of a frame."""
    if equirect:
        lon = F.col("x") / width * 2 * math.pi - math.pi
        lat = F.col("y") / height * math.pi - math.pi / 2
        ray = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
    else:
        nx, ny = 2 * F.col("x") / width - 1, 2 * F.col("y") / height - 1
        length = F.sqrt(nx * nx + ny * ny + 1.0) + 1e-6
        ray = [nx / length, ny / length, 1.0 / length]
    p = points.select(*keys, *[r.alias(f"r{i}") for i, r in enumerate(ray)])
    cov = {(i, j): F.covar_samp(f"r{i}", f"r{j}").alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)}
    c = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), *cov.values())
    a, b, d = (F.col(f"c{i}{i}") for i in range(3))
    e, f, g = F.col("c01"), F.col("c02"), F.col("c12")
    q = (a + b + d) / 3.0
    off = e * e + f * f + g * g
    s = F.sqrt(((a - q) ** 2 + (b - q) ** 2 + (d - q) ** 2 + 2.0 * off) / 6.0)
    aa, bb, dd = a - q, b - q, d - q
    det = aa * (bb * dd - g * g) - e * (e * dd - g * f) + f * (e * g - bb * f)
    phi = F.acos(clip(F.when(s > 0, det / (2.0 * s**3)).otherwise(0.0), -1.0, 1.0)) / 3.0
    top = q + 2.0 * s * F.cos(phi)
    low = q + 2.0 * s * F.cos(phi + 2.0 * math.pi / 3.0)
    score = F.when((F.col("points") < 4) | (top < 1e-6), 0.0).otherwise(clip(low / top, 0.0, 1.0))
    return c.select(*keys, "points", score.alias("dispersion"))


def flow_magnitude(tracks: DataFrame, pair: Sequence[str], *, downscale: float = 1.0) -> DataFrame:
    """Mean displacement of successfully tracked points, in full-size pixels."""
    d = F.when(F.col("status") == 1, F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return tracks.groupBy(*pair).agg((F.coalesce(F.avg(d), F.lit(0.0)) / downscale).alias("flow_mag"))


def step_proxy(tracks: DataFrame, pair: Sequence[str], *, clip_px: float = 80.0) -> DataFrame:
    """Median displacement of the inliers, clipped."""
    d = F.when(F.col("inlier"), F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    q = exact_percentiles(tracks.select(*pair, d.alias("d")), pair, ["d"], [0.5])
    median = F.coalesce("d_p0", F.lit(0.0))
    return q.select(*pair, (F.least(median, F.lit(clip_px)) if clip_px > 0 else median).alias("step_proxy"))


def inlier_gate(
    tracks: DataFrame, pair: Sequence[str], *, min_matches: int = 15, min_points: int = 24, fast_fail: float = 0.12
) -> DataFrame:
    """Match counts, inlier ratio and whether a pair is worth estimating."""
    agg = tracks.groupBy(*pair).agg(F.count(F.lit(1)).alias("match_count"), F.count_if("inlier").alias("inliers"))
    ratio = F.col("inliers") / F.col("match_count")
    ok = (F.col("match_count") >= max(min_matches, min_points)) & (F.col("inliers") > 0) & (ratio >= fast_fail)
    return agg.withColumn("inlier_ratio", ratio).withColumn("is_valid", ok)


def coverage_map(poses: DataFrame, keys: Sequence[str], width: int, height: int, *, fov: float = 90.0) -> DataFrame:
    """Mean view weight per cell of a sphere grid: rows (keys, grid_row, grid_col, coverage).

    Each pose reaches only the grid rows within its field of view, and partial
    sums shrink to one row per cell before the shuffle.
    """
    keys = list(keys)
    half = math.radians(fov) / 2.0
    row_step = math.pi / (height - 1)
    pitch = F.radians(F.col("pitch"))
    first = F.greatest(F.ceil((math.pi / 2 - (pitch + half)) / row_step) - 1, F.lit(0))
    last = F.least(F.floor((math.pi / 2 - (pitch - half)) / row_step) + 1, F.lit(height - 1))
    reach = poses.select(*keys, view_direction("yaw", "pitch").alias("d"), first.alias("a"), last.alias("b")).filter("a <= b")
    cells = reach.withColumn("grid_row", F.explode(F.sequence("a", "b"))).withColumn(
        "grid_col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    phi = math.pi / 2 - F.col("grid_row") * row_step
    theta = -math.pi + F.col("grid_col") * (2 * math.pi / (width - 1))
    d = F.col("d")
    cos_angle = F.cos(phi) * F.cos(theta) * d[0] + F.sin(phi) * d[1] + F.cos(phi) * F.sin(theta) * d[2]
    angle = F.acos(clip(cos_angle, -1.0, 1.0))
    weight = F.exp(-4.0 * (angle / half) * (angle / half))
    seen = (
        cells.withColumn("w", F.when(cos_angle >= math.cos(half), weight))
        .filter(F.col("w").isNotNull())
        .groupBy(*keys, "grid_row", "grid_col")
        .agg(F.sum("w").alias("w"))
    )
    counts = poses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.withColumn("grid_row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)).cast("array<bigint>"))).withColumn(
        "grid_col", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    )
    out = grid.join(seen, [*keys, "grid_row", "grid_col"], "left")
    return out.select(*keys, "grid_row", "grid_col", clip(F.coalesce("w", F.lit(0.0)) / F.col("n"), 0.0, 1.0).alias("coverage"))


def line_straightness(segments: DataFrame, keys: Sequence[str], cx: float, cy: float, radius: float) -> DataFrame:
    """Total segment length before and after undistortion, whole frame and centre circle.

    ``stage`` is ``before`` or ``after``; a segment is central if its midpoint is.
    """
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    mx, my = (F.col("x1") + F.col("x2")) / 2.0 - cx, (F.col("y1") + F.col("y2")) / 2.0 - cy
    central = mx * mx + my * my <= radius * radius
    total = lambda stage, where: F.coalesce(F.sum(F.when((F.col("stage") == stage) & where, length)), F.lit(0.0))
    out = segments.groupBy(*keys).agg(
        *[
            total(stage, where).alias(f"{area}_{stage}")
            for area, where in (("full", F.lit(True)), ("center", central))
            for stage in ("before", "after")
        ]
    )
    ratio = lambda area: F.when(
        F.col(f"{area}_before") <= 1e-9, F.when(F.col(f"{area}_after") <= 1e-9, 0.0).otherwise(999.0)
    ).otherwise(F.col(f"{area}_after") / F.col(f"{area}_before"))
    return out.withColumns({f"{area}_ratio": ratio(area) for area in ("full", "center")})


def check_frames(videos: DataFrame, keys: Sequence[str], count: str = "frame_count") -> DataFrame:
    """Frames sampled for the check: first, quarter, half, three quarters, last."""
    n = F.col(count)
    picks = F.array(F.lit(0).cast("bigint"), F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4), F.greatest(n - 1, F.lit(0)))
    return videos.select(*keys, F.explode(F.array_distinct(F.when(n > 0, picks).otherwise(F.array(F.lit(0).cast("bigint"))))).alias("frame_index"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: Sequence[str], *, keep: bool = False, copies: int = 8, spread: str = "point_id") -> DataFrame:
    """Drop (or ``keep``) the points inside any box of their frame.

    Semi and anti joins emit no pairs, and the points of one frame spread over
    ``copies`` tasks.
    """
    b = boxes.select(*keys, "x1", "y1", "x2", "y2").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    p = points.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int"))
    same = [p[k] == b[k] for k in [*keys, "_salt"]]
    inside = (p["x"] >= b["x1"]) & (p["x"] < b["x2"]) & (p["y"] >= b["y1"]) & (p["y"] < b["y2"])
    cond = inside
    for c in same:
        cond = cond & c
    return p.join(b, cond, "left_semi" if keep else "left_anti").drop("_salt")


def seam_count(points: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Points on and off the seam columns of a stitched panorama."""
    half = max(4, width // 80)
    x = F.floor(F.col("x"))
    seam = F.lit(False)
    for c in (0, width // 2, width - 1):
        seam = seam | ((x >= max(0, c - half)) & (x < min(width, c + half)))
    return points.groupBy(*keys).agg(F.count_if(seam).alias("seam_points"), F.count_if(~seam).alias("free_points"))


def valid_value(mask: Column, mask_max: Column) -> Column:
    """255 where a mask allows features: 0/1 masks exclude ones, 0/255 masks exclude zeros."""
    return F.when(F.when(mask_max <= 1, mask == 0).otherwise(mask > 0), 255).otherwise(0)


# Detection labels and the class names they stand for.
TARGET_CLASSES = {
    "人物": ("person",),
    "人": ("person",),
    "自転車": ("bicycle",),
    "バイク": ("motorcycle",),
    "車両": ("car", "bus", "truck"),
    "空": (),
    "動物": ("bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe"),
}
OTHER = "その他"


def detection_filter(detections: DataFrame, targets: Sequence[str], *, min_confidence: float = 0.25) -> DataFrame:
    """Detections of the wanted labels; the "other" label means every class no label covers."""
    known = sorted({c for names in TARGET_CLASSES.values() for c in names})
    wanted = sorted({c for t in targets if t != OTHER for c in TARGET_CLASSES.get(t, (t,))})
    sure = detections.filter(F.col("confidence") >= min_confidence)
    if not targets:
        return sure
    hit = F.col("class_name").isin(*wanted)
    if OTHER in targets:
        hit = hit | ~F.col("class_name").isin(*known)
    return sure.filter(hit)
