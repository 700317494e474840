"""Small column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float | Column, high: float | Column) -> Column:
    """Clamp to [low, high]; null stays null (least/greatest would skip it)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def is_finite(c: str | Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite (NaN sorts above infinity)."""
    return F.coalesce(F.abs(col(c)) < F.lit(float("inf")), F.lit(False))


def finite(c: str | Column) -> Column:
    c = col(c)
    return F.when(is_finite(c), c)


def half_even(c: Column, low: int | Column | None = None) -> Column:
    """Round half to even, as bigint, optionally bounded below."""
    out = F.rint(c).cast("bigint")
    if low is None:
        return out
    return F.greatest(out, low if isinstance(low, Column) else F.lit(low).cast("bigint"))


def clean_zero(c: Column) -> Column:
    """Turn -0.0 into 0.0."""
    return c + F.lit(0.0)
