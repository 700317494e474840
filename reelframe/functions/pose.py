"""Rotations, view directions and camera intrinsics as column expressions.

Quaternions are (w, x, y, z) arrays, matrices are row-major arrays of nine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelframe.functions.common import clip, col, half_even


def norm(v: Column, n: int) -> Column:
    return F.sqrt(sum((v[i] * v[i] for i in range(1, n)), v[0] * v[0]))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return sum((a[i] * b[i] for i in range(1, n)), a[0] * b[0])


def unit(v: Column, n: int = 3) -> Column:
    """Unit vector, or zeros for a vanishing one."""
    length = norm(v, n)
    return F.transform(v, lambda x: F.when(length > 1e-12, x / length).otherwise(0.0))


def matrix_from_quaternion(q: str | Column) -> Column:
    """Rotation matrix of a quaternion of any length; identity for a vanishing one."""
    q = col(q)
    length = norm(q, 4)
    w, x, y, z = (q[i] / length for i in range(4))
    entries = [
        1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - z * w), 2.0 * (x * z + y * w),
        2.0 * (x * y + z * w), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - x * w),
        2.0 * (x * z - y * w), 2.0 * (y * z + x * w), 1.0 - 2.0 * (x * x + y * y),
    ]
    identity = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    return F.when(length > 1e-12, F.array(*entries)).otherwise(identity)


def quaternion_from_matrix(m: str | Column) -> Column:
    """Unit quaternion with the largest component positive."""
    m = col(m)
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    quarter = F.lit(0.25)

    def root(v: Column) -> Column:
        return F.sqrt(F.greatest(v, F.lit(1e-12))) * 2.0

    st, sx, sy, sz = root(a + e + i + 1.0), root(1.0 + a - e - i), root(1.0 + e - a - i), root(1.0 + i - a - e)
    raw = (
        F.when(a + e + i > 0, F.array(quarter * st, (h - f) / st, (c - g) / st, (d - b) / st))
        .when((a > e) & (a > i), F.array((h - f) / sx, quarter * sx, (b + d) / sx, (c + g) / sx))
        .when(e > i, F.array((c - g) / sy, (b + d) / sy, quarter * sy, (f + h) / sy))
        .otherwise(F.array((d - b) / sz, (c + g) / sz, (f + h) / sz, quarter * sz))
    )
    length = norm(raw, 4)
    return F.transform(raw, lambda x: x / length)


def _product(a: list[Column], b: list[Column]) -> list[Column]:
    """Product of two row-major 3x3 matrices given as lists of entries."""
    return [sum((a[r * 3 + k] * b[k * 3 + c] for k in (1, 2)), a[r * 3] * b[c]) for r in range(3) for c in range(3)]


def matmul(a: Column, b: Column) -> Column:
    return F.array(*_product([a[i] for i in range(9)], [b[i] for i in range(9)]))


def matrix_from_ypr(yaw: str | Column, pitch: str | Column, roll: str | Column) -> Column:
    """Rz(roll) Ry(yaw) Rx(pitch) from angles in degrees."""
    y, p, r = (F.radians(col(c)) for c in (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = F.cos(y), F.sin(y), F.cos(p), F.sin(p), F.cos(r), F.sin(r)
    zero = F.lit(0.0)
    turned = [cy, sy * sp, sy * cp, zero, cp, -sp, -sy, cy * sp, cy * cp]
    return F.array(*_product([cr, -sr, zero, sr, cr, zero, zero, zero, F.lit(1.0)], turned))


def rotation_degrees(m: str | Column) -> Column:
    m = col(m)
    return F.degrees(F.acos(clip((m[0] + m[4] + m[8] - 1.0) * 0.5, -1.0, 1.0)))


def view_direction(yaw: str | Column, pitch: str | Column) -> Column:
    y, p = F.radians(col(yaw)), F.radians(col(pitch))
    return F.array(F.cos(p) * F.cos(y), F.sin(p), F.cos(p) * F.sin(y))


def view_overlap(yaw1, pitch1, yaw2, pitch2, fov: float = 90.0) -> Column:
    """Share of the field of view two directions have in common."""
    angle = F.acos(clip(dot(view_direction(yaw1, pitch1), view_direction(yaw2, pitch2)), -1.0, 1.0))
    return clip(1.0 - angle / math.radians(fov), 0.0, 1.0)


def pixel_direction(x: str | Column, y: str | Column, width: int, height: int) -> Column:
    """Unit direction of a pixel of an equirectangular image."""
    theta = col(x) / width * (2.0 * math.pi) - math.pi
    phi = (height / 2.0 - col(y)) / height * math.pi - math.pi / 2.0
    raw = F.array(F.cos(phi) * F.cos(theta), F.sin(phi), F.cos(phi) * F.sin(theta))
    length = norm(raw, 3) + 1e-8
    return F.transform(raw, lambda v: v / length)


def scaled_size(width: Column, height: Column, long_edge: int = 1000) -> tuple[Column, Column, Column]:
    """Scale, width and height after limiting the longer edge."""
    longest = F.greatest(width, height)
    scale = F.when((F.lit(long_edge) <= 0) | (longest <= long_edge), 1.0).otherwise(F.lit(float(long_edge)) / longest)
    one = F.lit(1).cast("bigint")
    return scale, half_even(width * scale, one), half_even(height * scale, one)


def scaled_intrinsics(k: str | Column, width: Column, height: Column, long_edge: int = 1000) -> Column:
    """(fx, fy, cx, cy) at the limited size; longer edge as focal length without ``k``."""
    k = col(k)
    scale, w, h = scaled_size(width, height, long_edge)
    focal = F.greatest(w, h).cast("double")
    return F.when(
        k.isNotNull(), F.array(k[0] * scale, k[4] * scale, k[2] * scale, k[5] * scale)
    ).otherwise(F.array(focal, focal, w * 0.5, h * 0.5))


def export_intrinsics(k: str | Column, width: Column, height: Column) -> Column:
    """(fx, fy, cx, cy) for exports; half the longer edge as focal length as fallback."""
    k = col(k)
    w, h = F.greatest(width, F.lit(1)), F.greatest(height, F.lit(1))
    focal = F.greatest(w, h) * 0.5
    usable = k.isNotNull() & (F.size(k) == 9) & (k[0] > 0) & (k[4] > 0)
    return F.when(usable, F.array(k[0], k[4], k[2], k[5])).otherwise(F.array(focal, focal, w * 0.5, h * 0.5))
