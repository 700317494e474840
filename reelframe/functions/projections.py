"""Where each pixel of a reprojected view comes from, as NumPy coordinate maps."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# For each cube face the image of the horizontal axis, the centre
# direction and the vertical axis.
CUBE_FACES = {
    "front": ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    "back": ((-1, 0, 0), (0, 1, 0), (0, 0, -1)),
    "right": ((0, 0, 1), (0, 1, 0), (-1, 0, 0)),
    "left": ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
    "up": ((1, 0, 0), (0, 0, -1), (0, 1, 0)),
    "down": ((1, 0, 0), (0, 0, 1), (0, -1, 0)),
}


# What is added to the length of a ray, and how far source positions stay from the last pixel.
GUARD, MARGIN = 1e-8, 1.001


def _on_equirect(rays: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Source position of rays on an equirectangular image: share of a turn across, share of the way from the pole down."""
    turn = (np.arctan2(rays[..., 2], rays[..., 0]) / (2.0 * math.pi) + 0.5) % 1.0
    fall = np.arccos(np.clip(rays[..., 1] / (np.sqrt((rays * rays).sum(-1)) + GUARD), -1.0, 1.0)) / math.pi
    return np.minimum(turn * width, width - MARGIN), np.minimum(fall * height, height - MARGIN)


def _view(axes: np.ndarray, focal: float, out_width: int, out_height: int) -> np.ndarray:
    """Rays of a view whose image axes and viewing direction are the rows of ``axes``; the image spans -1 to 1."""
    y, x = np.ix_(np.linspace(-1, 1, out_height), np.linspace(-1, 1, out_width))
    plane = np.stack(np.broadcast_arrays(x, y, focal), axis=-1)
    return plane @ axes


def _rotation(axis: int, angle: float) -> np.ndarray:
    """Rotation of row vectors around a coordinate axis."""
    c, s = math.cos(angle), math.sin(angle)
    i, j = (axis + 1) % 3, (axis + 2) % 3
    out = np.eye(3)
    out[i, i] = out[j, j] = c
    out[i, j], out[j, i] = s, -s
    return out


@lru_cache(maxsize=64)
def cube_face(width: int, height: int, size: int, face: str) -> tuple[np.ndarray, np.ndarray]:
    """A face is a view of 90 degrees, so its focal length is 1."""
    across, centre, down = CUBE_FACES[face]
    return _on_equirect(_view(np.array([across, down, centre], float), 1.0, size, size), width, height)


@lru_cache(maxsize=64)
def perspective(
    width: int, height: int, out_width: int, out_height: int, yaw: float, pitch: float, fov: float
) -> tuple[np.ndarray, np.ndarray]:
    """A view turned by yaw around the vertical axis and then by pitch around the horizontal one."""
    axes = _rotation(1, -math.radians(yaw)).T @ _rotation(0, math.radians(pitch))
    return _on_equirect(_view(axes, 1.0 / math.tan(math.radians(fov) / 2.0), out_width, out_height), width, height)


def _sphere(out_width: int, out_height: int) -> np.ndarray:
    """Unit rays of an equirectangular image: ahead, up, right."""
    up, turn = np.ix_(np.linspace(math.pi / 2, -math.pi / 2, out_height), np.linspace(-math.pi, math.pi, out_width))
    return np.stack(np.broadcast_arrays(np.cos(up) * np.cos(turn), np.sin(up), np.cos(up) * np.sin(turn)), axis=-1)


@lru_cache(maxsize=32)
def fisheye_equirect(
    width: int, height: int, out_width: int, out_height: int, fx: float, fy: float, cx: float, cy: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equidistant fisheye unrolled onto the sphere; the front half is valid.

    A ray lands as far from the centre as its angle to the axis, in the direction in which it leaves the axis.
    """
    rays = _sphere(out_width, out_height)
    aside = rays[..., 2] + 1j * rays[..., 1]
    landing = np.arctan2(np.abs(aside), rays[..., 0]) * np.exp(1j * np.angle(aside))
    place = lambda part, f, c, size: np.clip(f * part + c, 0, size - 1)
    return place(landing.real, fx, cx, width), place(landing.imag, fy, cy, height), rays[..., 0] > 0


@lru_cache(maxsize=32)
def cube_lookup(size: int, out_width: int, out_height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the face, x, y inside it) per output pixel: the face whose axis its ray follows most."""
    axes = np.array(list(CUBE_FACES.values()), float)
    right, up, ahead = np.moveaxis(np.einsum("hwi,fij->fhwj", _sphere(out_width, out_height), axes), -1, 0)
    face = np.argmax(ahead, axis=0)
    own = lambda a: np.take_along_axis(a, face[None], 0)[0]
    x, y = (0.5 * (size - 1) * (1.0 + s * own(a) / own(ahead)) for s, a in ((1, right), (-1, up)))
    return face, np.clip(x, 0, size - 1), np.clip(y, 0, size - 1)


# Angles of the five views cut from one fisheye lens.
CROSS5_YAW = CROSS5_PITCH = 50.5
CROSS5_INWARD = 25.0
CROSS5_FOV = 80.0


def cross5_views(
    yaw: float = CROSS5_YAW, pitch: float = CROSS5_PITCH, inward: float = CROSS5_INWARD
) -> list[tuple[str, float, float]]:
    """(label, yaw, pitch); opposite sides swap labels because the image is mirrored."""
    y, p = max(0.0, yaw - inward), max(0.0, pitch - inward)
    return [("front", 0.0, 0.0), ("left", y, 0.0), ("right", -y, 0.0), ("down", 0.0, p), ("up", 0.0, -p)]


@lru_cache(maxsize=64)
def lens_view(
    k: tuple[float, ...], dist: tuple[float, ...], yaw: float, pitch: float, size: int, fov: float = CROSS5_FOV
) -> tuple[np.ndarray, np.ndarray]:
    """Source position in a distorted lens image for a rotated pinhole view.

    Four coefficients select the equidistant fisheye model, otherwise the
    radial-tangential one (k1, k2, p1, p2, k3).
    """
    f = size / (2.0 * math.tan(math.radians(fov) / 2.0))
    i, j = np.meshgrid(np.arange(size, dtype=float), np.arange(size, dtype=float))
    rays = np.stack([(i - size / 2.0) / f, (j - size / 2.0) / f, np.ones_like(i)], axis=-1)
    a, b = math.radians(yaw), math.radians(pitch)
    ry = np.array([[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]])
    rx = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    d = rays @ (ry @ rx)
    with np.errstate(divide="ignore", invalid="ignore"):
        u, v = d[..., 0] / d[..., 2], d[..., 1] / d[..., 2]
    if len(dist) == 4:
        r = np.hypot(u, v)
        t = np.arctan(r)
        t2 = t * t
        bent = t * (1 + t2 * (dist[0] + t2 * (dist[1] + t2 * (dist[2] + t2 * dist[3]))))
        s = np.where(r > 1e-8, bent / np.where(r > 1e-8, r, 1.0), 1.0)
        u, v = u * s, v * s
    else:
        k1, k2, p1, p2, k3 = dist
        r2 = u * u + v * v
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        u, v = (
            u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u),
            v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v,
        )
    behind = d[..., 2] <= 0
    x, y = k[0] * u + k[1] * v + k[2], k[4] * v + k[5]
    return np.where(behind, -1e6, x), np.where(behind, -1e6, y)


def _taps(x: np.ndarray, y: np.ndarray):
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - x0, y - y0
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            yield y0 + dy, x0 + dx, wy * wx


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray, wrap: bool = False) -> np.ndarray:
    """Bilinear values of ``img`` at (x, y); outside it wraps around or counts as 0."""
    h, w = img.shape[:2]
    far = (np.abs(x) > 1e5) | (np.abs(y) > 1e5) | ~np.isfinite(x) | ~np.isfinite(y)
    x, y = np.where(far, -10.0, x), np.where(far, -10.0, y)
    out = np.zeros(x.shape + img.shape[2:])
    for ty, tx, wt in _taps(x, y):
        inside = (tx >= 0) & (tx < w) & (ty >= 0) & (ty < h) | wrap
        wt = np.where(inside, wt, 0.0)
        out += img[ty % h, tx % w] * (wt[..., None] if img.ndim == 3 else wt)
    return out


def lookup_taps(x: np.ndarray, y: np.ndarray, w: int, h: int, wrap: bool = False) -> dict[str, np.ndarray]:
    """Output pixel (y, x), source pixel (sy, sx) and weight of each tap of a coordinate map; zero weights left out."""
    iy, ix = np.indices(x.shape)
    found = []
    for ty, tx, wt in _taps(x, y):
        keep = (wt > 0) & ((tx >= 0) & (tx < w) & (ty >= 0) & (ty < h) | wrap)
        found.append((iy[keep], ix[keep], (ty % h)[keep], (tx % w)[keep], wt[keep]))
    return dict(zip(("y", "x", "sy", "sx", "w"), map(np.concatenate, zip(*found))))


def to_bytes(values: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(values, 0, 255) + 0.5).astype(np.uint8)
