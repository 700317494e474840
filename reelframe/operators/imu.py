"""Inertial samples: gravity, integration, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.plans.blocks import BLOCK_ROWS, along, attach, halo_window, own_rows, previous, running_sum, with_halo

AXES = ("x", "y", "z")


def gravity_moving_average(
    df: DataFrame,
    keys: Sequence[str],
    ordinal: str,
    *,
    window: int = 100,
    prefix: str = "a",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Centred box filter over ``window`` rows (rows -w/2 .. w/2-1), zero-padded at the ends.

    Adds ``g<axis>`` (gravity) and ``d<axis>`` (what is left of the acceleration).
    """
    half = window // 2
    out = with_halo(df, ordinal, half, window - half - 1, span=span)
    w = halo_window(keys, ordinal).rowsBetween(-half, window - half - 1)
    out = out.withColumns({f"g{a}": F.sum(prefix + a).over(w) / float(window) for a in AXES})
    return own_rows(out.withColumns({f"d{a}": F.col(prefix + a) - F.col(f"g{a}") for a in AXES}))


def integrate_trapezoid(
    df: DataFrame, keys: Sequence[str], order: str, *, time: str, inputs: Sequence[str], outputs: Sequence[str],
    block: str | None = None,
) -> DataFrame:
    """Cumulative trapezoid integral of each input over ``time``; the first row is 0."""
    lagged = F.struct(F.col(time).alias("t"), *[F.col(c).alias(c) for c in inputs])
    out = along(df, keys, [order], {"_p": previous(lagged)}, block=block)
    dt = F.col(time) - F.col("_p.t")
    area = lambda c: F.when(F.col("_p.t").isNull(), 0.0).otherwise((F.col(c) + F.col(f"_p.{c}")) * 0.5 * dt)
    out = out.withColumns({f"_i_{c}": area(c) for c in inputs})
    out = along(
        out, keys, [order], {o: running_sum(f"_i_{c}") for c, o in zip(inputs, outputs, strict=True)}, block=block
    )
    return out.drop("_p", *[f"_i_{c}" for c in inputs])


def remove_linear_trend(
    df: DataFrame, keys: Sequence[str], ordinal: str, columns: Sequence[str]
) -> DataFrame:
    """Subtract the least-squares line on the row number from each column."""
    n = F.col(ordinal).cast("double")
    fit = df.groupBy(*keys).agg(
        *[F.coalesce(F.regr_slope(F.col(c), n), F.lit(0.0)).alias(f"_m_{c}") for c in columns],
        *[F.coalesce(F.regr_intercept(F.col(c), n), F.avg(c)).alias(f"_b_{c}") for c in columns],
    )
    out = attach(df, fit, keys, F.col(ordinal))
    return out.withColumns({c: F.col(c) - (F.col(f"_m_{c}") * n + F.col(f"_b_{c}")) for c in columns}).drop(
        *[f"_{p}_{c}" for c in columns for p in "mb"]
    )


def imu_summary(
    df: DataFrame, keys: Sequence[str], order: str, *, time: str = "t", accel: str = "a", dynamic: str = "d", position: str = "p"
) -> DataFrame:
    """Sample rate, mean gravity, dynamic RMS, path length and straight-line distance."""
    place = F.struct(*[F.col(position + a).alias(a) for a in AXES])
    out = along(df, keys, [order], {"_p": previous(place)})
    hop = F.sqrt(sum(((F.col(position + a) - F.col(f"_p.{a}")) ** 2 for a in AXES[1:]), (F.col(position + "x") - F.col("_p.x")) ** 2))
    size = F.sqrt(sum((F.col(accel + a) ** 2 for a in AXES[1:]), F.col(accel + "x") ** 2))
    moved = sum((F.col(dynamic + a) ** 2 for a in AXES[1:]), F.col(dynamic + "x") ** 2)
    agg = out.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.min(time).alias("_t0"),
        F.max(time).alias("_t1"),
        F.avg(size).alias("gravity"),
        F.sqrt(F.avg(moved)).alias("dynamic_rms"),
        F.coalesce(F.sum(hop), F.lit(0.0)).alias("path_length"),
        F.min_by(place, order).alias("_a"),
        F.max_by(place, order).alias("_b"),
    )
    span = F.col("_t1") - F.col("_t0")
    far = F.sqrt(sum(((F.col(f"_b.{a}") - F.col(f"_a.{a}")) ** 2 for a in AXES[1:]), (F.col("_b.x") - F.col("_a.x")) ** 2))
    return agg.select(
        *keys,
        "samples",
        F.when(span > 0, F.col("samples") / span).otherwise(0.0).alias("sample_rate"),
        "gravity",
        "dynamic_rms",
        "path_length",
        far.alias("distance"),
    )
