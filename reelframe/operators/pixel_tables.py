"""The same metrics on an exploded pixel table (keys, y, x, v), for small frames.

A frame holds ``width * height`` rows, which bounds every window partition here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.common import clip, half_even


def roi_predicate(height: int, width: int, mode: str = "circle", ratio: float = 0.40) -> Column:
    """Pixels inside the centred circle or rectangle."""
    y, x = F.col("y"), F.col("x")
    if mode == "rect":
        w, h = max(1, round(width * ratio)), max(1, round(height * ratio))
        x0, y0 = max(0, (width - w) // 2), max(0, (height - h) // 2)
        return y.between(y0, y0 + h - 1) & x.between(x0, x0 + w - 1)
    radius = max(1, round(min(width, height) * 0.5 * ratio))
    return in_circle(width // 2, height // 2, radius)


def in_circle(cx: float, cy: float, radius: float) -> Column:
    dx, dy = F.col("x") - cx, F.col("y") - cy
    return dx * dx + dy * dy <= radius * radius


def with_neighbours(pixels: DataFrame, keys: Sequence[str], height: int, width: int, value: str = "v") -> DataFrame:
    """Add ``n_<dy>_<dx>`` for the eight neighbours, mirrored at the borders.

    In row order a neighbour lies a fixed number of rows away, so one window
    per frame serves all eight.
    """
    w = Window.partitionBy(*keys).orderBy("y", "x")

    def shifted(dy: int, dx: int) -> Column:
        offset = dy * width + dx
        return F.lead(value, offset).over(w) if offset > 0 else F.lag(value, -offset).over(w)

    def pick(dy: int, dx: int) -> Column:
        options = None
        for ey in {dy, -dy}:
            for ex in {dx, -dx}:
                bad_y = (F.col("y") + dy < 0) | (F.col("y") + dy >= height)
                bad_x = (F.col("x") + dx < 0) | (F.col("x") + dx >= width)
                here = (bad_y if ey != dy else ~bad_y) & (bad_x if ex != dx else ~bad_x)
                options = F.when(here, shifted(ey, ex)) if options is None else options.when(here, shifted(ey, ex))
        return options

    name = lambda dy, dx: f"n_{dy + 1}_{dx + 1}"
    return pixels.withColumns(
        {name(dy, dx): pick(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx}
    )


def _n(dy: int, dx: int) -> Column:
    return F.col(f"n_{dy + 1}_{dx + 1}")


def with_gradients(pixels: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """Add ``lap``, ``gx`` and ``gy``."""
    out = with_neighbours(pixels, keys, height, width)
    right = _n(-1, 1) + 2 * _n(0, 1) + _n(1, 1)
    left = _n(-1, -1) + 2 * _n(0, -1) + _n(1, -1)
    below = _n(1, -1) + 2 * _n(1, 0) + _n(1, 1)
    above = _n(-1, -1) + 2 * _n(-1, 0) + _n(-1, 1)
    out = out.withColumns(
        {
            "lap": _n(-1, 0) + _n(1, 0) + _n(0, -1) + _n(0, 1) - 4 * F.col("v"),
            "gx": right - left,
            "gy": below - above,
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("n_")])


def raw_quality_table(
    pixels: DataFrame, keys: Sequence[str], height: int, width: int, *, mode: str = "circle", ratio: float = 0.40
) -> DataFrame:
    grad = with_gradients(pixels, keys, height, width).filter(roi_predicate(height, width, mode, ratio))
    out = grad.groupBy(*keys).agg(
        F.var_pop("lap").alias("laplacian_var"),
        F.avg(F.col("gx") ** 2 + F.col("gy") ** 2).alias("tenengrad"),
        F.avg((F.col("v") <= 16).cast("double")).alias("black_clip"),
        F.avg((F.col("v") >= 245).cast("double")).alias("white_clip"),
        F.stddev_pop("v").alias("contrast"),
        F.count(F.lit(1)).cast("double").alias("roi_pixel_count"),
    )
    exposure = 0.7 * F.least(F.col("contrast") / 64.0, F.lit(1.0)) + 0.3 * (
        1 - F.least(F.col("black_clip") + F.col("white_clip"), F.lit(1.0))
    )
    return out.withColumn("exposure_roi", clip(exposure, 0.0, 1.0))


def half_scale(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shrink by two in each direction; byte rounding."""
    return (
        pixels.groupBy(*keys, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
        .agg(F.floor(F.avg("v") + 0.5).cast("double").alias("v"))
    )


def blur_and_depth(
    pixels: DataFrame, keys: Sequence[str], height: int, width: int, *, beta: float = 5.0, bins: int = 18
) -> DataFrame:
    """Sharpness, direction imbalance, angle concentration, depth proxy and brightness term."""
    keys = list(keys)
    grad = with_gradients(pixels, keys, height, width)
    mag = F.hypot("gx", "gy")
    angle = (F.atan2("gy", "gx") + math.pi) % F.lit(math.pi)
    grad = grad.withColumn("mag", mag).withColumn(
        "cell", F.least(F.floor(angle / F.lit(math.pi) * bins), F.lit(bins - 1))
    )
    ex, ey = F.sum(F.abs("gx")), F.sum(F.abs("gy"))
    flat = (ex + ey) < 1e-6
    base = grad.groupBy(*keys).agg(
        F.var_pop("lap").alias("sharpness"),
        F.when(flat, 0.0).otherwise(clip(F.abs(ex / (ex + ey) - 0.5) * 2.0, 0.0, 1.0)).alias("imbalance"),
        F.max("mag").alias("peak"),
        F.sum("mag").alias("total"),
        F.avg("v").alias("brightness"),
    )
    share = F.col("m") / F.col("total")
    entropy = (
        grad.groupBy(*keys, "cell").agg(F.sum("mag").alias("m"))
        .join(base.select(*keys, "total"), keys)
        .groupBy(*keys)
        .agg(F.sum(F.when(F.col("m") > 0, -share * F.log2(share)).otherwise(0.0)).alias("entropy"))
    )
    w = F.col("mag") / F.col("peak")
    e = F.when(w > 0.01, w * F.exp(beta * (w - 1.0)))
    depth = (
        grad.join(base.select(*keys, "peak"), keys)
        .groupBy(*keys)
        .agg((F.sum(e * w) / F.sum(e)).alias("depth"))
    )
    out = base.join(entropy, keys).join(depth, keys)
    d = F.col("brightness") - 128.0
    return out.select(
        *keys,
        "sharpness",
        "imbalance",
        F.when(F.col("total") <= 1e-6, 0.0)
        .otherwise(clip(1.0 - F.col("entropy") / math.log2(bins), 0.0, 1.0))
        .alias("angle_score"),
        F.when(F.col("peak") < 1e-6, 0.5).otherwise(clip(F.log2(1.0 + F.col("depth")), 0.0, 1.0)).alias("softmax_depth"),
        F.exp(-(d * d) / (2 * 80.0 * 80.0)).alias("exposure_gauss"),
    )


# A lookup row is about 50 bytes, so this many stay below 50 MB.
BROADCAST_ROWS = 1_000_000


def reproject(pixels: DataFrame, lookup: DataFrame, keys: Sequence[str], *, copies: int = 64) -> DataFrame:
    """Apply a lookup (view, y, x, sy, sx, w): weighted sum of source pixels.

    All frames share the few join keys (sy, sx). A lookup whose counted size is
    small is broadcast; a larger one is copied per salt, so that no pixel position
    gathers every frame in one task.
    """
    src = pixels.select(*keys, F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    if lookup.count() <= BROADCAST_ROWS:
        joined = src.join(F.broadcast(lookup), ["sy", "sx"])
    else:
        salted = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        src = src.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(copies)).cast("int"))
        joined = src.join(salted, ["sy", "sx", "_salt"])
    return joined.groupBy(*keys, "view", "y", "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def region_mask(height: int, width: int, kind: str, ratio: float | None = None) -> Column:
    """True where a region mask removes the pixel.

    ``fisheye`` keeps the centred lens circle, ``polar`` cuts bands at the top and
    bottom, ``nadir`` and ``zenith`` cut a circle at the lower or upper edge.
    """
    y = F.col("y")
    if kind == "fisheye":
        r = int(min(width, height) * 0.5 * min(max(0.94 if ratio is None else ratio, 0.0), 1.0))
        return ~in_circle(width // 2, height // 2, r) if r > 0 else F.lit(True)
    if kind == "polar":
        margin = int(height * (0.10 if ratio is None else ratio))
        return (y < margin) | (y >= height - margin) if margin > 0 else F.lit(False)
    if kind in ("nadir", "zenith"):
        r = int(height * ((0.15 if kind == "nadir" else 0.05) if ratio is None else ratio))
        return in_circle(width // 2, height - r if kind == "nadir" else r, r)
    raise ValueError(kind)


def apply_region(pixels: DataFrame, height: int, width: int, kind: str, *, ratio: float | None = None, fill: float = 0.0) -> DataFrame:
    removed = region_mask(height, width, kind, ratio)
    return pixels.withColumn("v", F.when(removed, F.lit(float(fill))).otherwise(F.col("v")))


def mask_stats(mask: DataFrame, keys: Sequence[str], masked: str = "masked") -> DataFrame:
    """Total and masked pixels and their ratio per frame."""
    return mask.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pixels"),
        F.count_if(masked).alias("masked_pixels"),
        (F.count_if(masked) / F.count(F.lit(1))).alias("mask_ratio"),
    )


def mask_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels valid in both masks; masks list their valid pixels."""
    return a.select(*keys, "y", "x").intersect(b.select(*keys, "y", "x"))


def mask_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys, "y", "x").union(b.select(*keys, "y", "x")).distinct()


def byte_value(c: Column) -> Column:
    return half_even(clip(c, 0.0, 255.0))
