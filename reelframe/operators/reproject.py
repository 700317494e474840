"""Reprojections and blends of whole frames, one frame to n views."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.functions import kernels as N
from reelframe.functions import projections as R

_SHAPE = ["data", "height", "width", "channels"]
_OUT = "view string, data binary, height int, width int, channels int"


def _image_rows(frames: DataFrame, keys: Sequence[str], views: Callable[[np.ndarray], Iterable[tuple[str, np.ndarray]]]) -> DataFrame:
    keys = list(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in keys) + ", " + _OUT

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                img = N.decode(row.data, row.height, row.width, row.channels)
                for view, out in views(img):
                    yield pd.DataFrame(
                        {
                            **{k: [getattr(row, k)] for k in keys},
                            "view": [view],
                            "data": [out.tobytes()],
                            "height": [out.shape[0]],
                            "width": [out.shape[1]],
                            "channels": [1 if out.ndim == 2 else out.shape[2]],
                        }
                    )

    return frames.select(*keys, *_SHAPE).mapInPandas(run, ddl)


def reproject_cubemap(frames: DataFrame, keys: Sequence[str], size: int = 1024) -> DataFrame:
    """Six cube faces per equirectangular frame."""

    def views(img):
        h, w = img.shape[:2]
        for face in R.CUBE_FACES:
            yield face, R.to_bytes(R.sample(img, *R.cube_face(w, h, size, face), wrap=True))

    return _image_rows(frames, keys, views)


def equirect_from_cubemap(faces: DataFrame, keys: Sequence[str], out_width: int = 4096) -> DataFrame:
    """Equirectangular frame from its six face rows; a group holds exactly one frame."""
    keys = list(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in faces.schema if f.name in keys)
    out_h = out_width // 2

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        images = {r.view: N.decode(r.data, r.height, r.width, r.channels).astype(float) for r in pdf.itertuples(index=False)}
        some = next(iter(images.values()))
        out = np.zeros((out_h, out_width) + some.shape[2:], np.uint8)
        faces_of, x, y = R.cube_lookup(some.shape[0], out_width, out_h)
        for number, name in enumerate(R.CUBE_FACES):
            mine = faces_of == number
            if name in images and mine.any():
                out[mine] = np.clip(R.sample(images[name], x[mine], y[mine]), 0, 255).astype(np.uint8)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(
            {**row, "data": [out.tobytes()], "height": [out_h], "width": [out_width], "channels": [1 if out.ndim == 2 else out.shape[2]]}
        )

    return (
        faces.select(*keys, "view", *_SHAPE)
        .groupBy(*keys)
        .applyInPandas(join, f"{ddl}, data binary, height int, width int, channels int")
    )


def reproject_perspective(
    frames: DataFrame, keys: Sequence[str], views: Sequence[tuple[str, float, float, float]], *, out_width: int, out_height: int
) -> DataFrame:
    """One row per (frame, view); ``views`` lists (name, yaw, pitch, field of view)."""

    def cut(img):
        h, w = img.shape[:2]
        for name, yaw, pitch, fov in views:
            yield name, R.to_bytes(R.sample(img, *R.perspective(w, h, out_width, out_height, yaw, pitch, fov), wrap=True))

    return _image_rows(frames, keys, cut)


def _lens(img: np.ndarray, k: Sequence[float] | None) -> tuple[float, float, float, float]:
    h, w = img.shape[:2]
    if k is None:
        return min(h, w) * 0.5, min(h, w) * 0.5, w * 0.5, h * 0.5
    return k[0], k[4], k[2], k[5]


def unroll_fisheye(img: np.ndarray, k: Sequence[float] | None, out_width: int, out_height: int) -> np.ndarray:
    h, w = img.shape[:2]
    x, y, valid = R.fisheye_equirect(w, h, out_width, out_height, *_lens(img, k))
    out = R.to_bytes(R.sample(img, x, y))
    out[~valid] = 0
    return out


def fisheye_to_equirect(
    frames: DataFrame, keys: Sequence[str], *, out_width: int, out_height: int, k: Sequence[float] | None = None
) -> DataFrame:
    return _image_rows(frames, keys, lambda img: [("equirect", unroll_fisheye(img, k, out_width, out_height))])


def _seams(width: int) -> np.ndarray:
    """Columns where two lenses meet: both ends and the middle."""
    return np.array([0, width // 2, width - 1])


def front_weights(width: int) -> np.ndarray:
    """Weight of the front lens per output column.

    It falls linearly from 1 to 0 over a stretch around each seam. In the front half the middle's fall is an
    upper bound of it, in the rear half the falls at the ends are lower bounds.
    """
    column, reach = np.arange(width), max(8, width // 40)
    begin, end = np.clip(_seams(width) - reach, 0, width), np.clip(_seams(width) + reach, 0, width)
    at = (column[:, None] - begin) / np.maximum(end - begin - 1, 1)
    left, middle, right = np.where((column[:, None] >= begin) & (column[:, None] < end), 1.0 - at, np.nan).T
    front = (2 * column <= width - 1).astype(float)
    return np.fmax(np.fmin(np.fmax(front, left), middle), right)


def seam_band(width: int) -> np.ndarray:
    """Columns near the seams between two lenses."""
    half = max(4, width // 80)
    offset = np.arange(width)[:, None] - _seams(width)
    return ((offset >= -half) & (offset < half)).any(axis=1)


def _pair_rows(pairs: DataFrame, keys: Sequence[str], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], view: str) -> DataFrame:
    """Join results of paired lenses: columns ``a_``/``b_`` of data and shape."""
    keys = list(keys)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys) + ", " + _OUT
    cols = [p + c for p in ("a_", "b_") for c in _SHAPE]

    def run(batches):
        for pdf in batches:
            for key, r in zip(pdf[keys].to_dict("records"), zip(*[pdf[c] for c in cols], strict=True), strict=True):
                out = merge(N.decode(*r[:4]), N.decode(*r[4:]))
                channels = 1 if out.ndim == 2 else out.shape[2]
                yield pd.DataFrame(
                    [{**key, "view": view, "data": out.tobytes(), "height": out.shape[0], "width": out.shape[1], "channels": channels}]
                )

    return pairs.select(*keys, *cols).mapInPandas(run, ddl)


def stitch_lenses(
    pairs: DataFrame, keys: Sequence[str], *, out_width: int, out_height: int, k_a: Sequence[float] | None = None, k_b: Sequence[float] | None = None
) -> DataFrame:
    """Front and rear fisheye frames blended into one equirectangular frame."""

    def merge(a, b):
        w = front_weights(out_width)
        w = w[None, :, None] if a.ndim == 3 else w[None, :]
        fa = unroll_fisheye(a, k_a, out_width, out_height).astype(float)
        fb = unroll_fisheye(b, k_b, out_width, out_height).astype(float)
        return np.clip(fa * w + fb * (1.0 - w), 0, 255).astype(np.uint8)

    return _pair_rows(pairs, keys, merge, "equirect")


def feather(a: np.ndarray, b: np.ndarray, mode: str = "horizontal", overlap: float = 0.15) -> np.ndarray:
    """Two images side by side, or one below the other, with a linear transition over the overlap.

    Each place along the joined side has the second image's share: 0, rising over the overlap, then 1. Lines that the
    second image doesn't have keep the first.
    """
    along = 0 if mode == "vertical" else 1
    both = int(a.shape[along] * overlap)
    share = np.concatenate([np.zeros(a.shape[along] - both), np.linspace(0, 1, both), np.ones(b.shape[along] - both)])
    lines = np.arange(a.shape[1 - along]) < b.shape[1 - along]
    share = np.outer(share, lines) if along == 0 else np.outer(lines, share)
    share = share.reshape(share.shape + (1,) * (a.ndim - 2))

    def padded(img: np.ndarray, before: int) -> np.ndarray:
        out = np.zeros(share.shape[:2] + a.shape[2:])
        part = img[:, : share.shape[1]] if along == 0 else img[: share.shape[0]]
        y, x = (before, 0) if along == 0 else (0, before)
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
        return out

    out = (1 - share) * padded(a, 0) + share * padded(b, a.shape[along] - both)
    return np.clip(out, 0, 255).astype(np.uint8)


def stitch_fast(pairs: DataFrame, keys: Sequence[str], *, mode: str = "horizontal") -> DataFrame:
    return _pair_rows(pairs, keys, lambda a, b: feather(a, b, mode), mode)


def split_cross5(
    frames: DataFrame,
    keys: Sequence[str],
    *,
    k: Sequence[float],
    dist: Sequence[float],
    size: int = 1600,
    fov: float = R.CROSS5_FOV,
    valid_ratio: float = 0.90,
    inner_ratio: float = 0.98,
    masks: bool = False,
) -> DataFrame:
    """Five pinhole views per fisheye frame, black outside the lens circle.

    ``masks`` treats the payload as a 0/255 mask and samples it by nearest pixel.
    """
    k, dist = tuple(map(float, k)), tuple(map(float, dist))

    def views(img):
        h, w = img.shape[:2]
        radius = max(1.0, min(k[2], k[5], w - 1 - k[2], h - 1 - k[5]) * inner_ratio)
        for name, yaw, pitch in R.cross5_views():
            x, y = R.lens_view(k, dist, yaw, pitch, size, fov)
            if masks:
                near = R.sample(img, np.rint(x), np.rint(y))
                yield name, np.where(near > 127, 255, 0).astype(np.uint8)
                continue
            inside = (x >= 0) & (x <= w - 1) & (y >= 0) & (y <= h - 1)
            inside &= (x - k[2]) ** 2 + (y - k[5]) ** 2 <= radius * radius
            pad = np.pad(inside.astype(float), 1, mode="reflect")
            share = sum(pad[a : a + size, b : b + size] for a in range(3) for b in range(3)) / 9.0
            keep = share >= valid_ratio
            out = R.to_bytes(R.sample(img, x, y))
            yield name, out * (keep[..., None] if out.ndim == 3 else keep).astype(np.uint8)

    return _image_rows(frames, keys, views)


LINES_A_TASK = 256


def _lookup(spark: SparkSession, maps: Sequence[tuple[str, Callable[[], tuple]]], out_height: int, width: int, height: int, wrap: bool = False) -> DataFrame:
    """Lookup (view, y, x, sy, sx, w) for the pixel-table form, made in tasks: one row of the range is a line of a view.

    A map gives the source x and y of each pixel of its view and, if not all count, which do.
    """

    def run(batches):
        for pdf in batches:
            lines = pdf["id"].to_numpy()
            for number in np.unique(lines // out_height):
                name, coordinates = maps[number]
                own = lines[lines // out_height == number] % out_height
                x, y, *valid = (part[own] for part in coordinates())
                if valid:
                    x = np.where(valid[0], x, -9.0)  # outside, so it has no taps
                taps = R.lookup_taps(x, y, width, height, wrap)
                yield pd.DataFrame({"view": name, **taps, "y": own[taps["y"]]})

    lines = len(maps) * out_height
    return spark.range(0, lines, 1, max(1, -(-lines // LINES_A_TASK))).mapInPandas(run, "view string, y int, x int, sy int, sx int, w double")


def cubemap_lookup(spark: SparkSession, width: int, height: int, size: int) -> DataFrame:
    return _lookup(spark, [(f, partial(R.cube_face, width, height, size, f)) for f in R.CUBE_FACES], size, width, height, wrap=True)


def perspective_lookup(
    spark: SparkSession, width: int, height: int, views: Sequence[tuple[str, float, float, float]], out_width: int, out_height: int
) -> DataFrame:
    maps = [(name, partial(R.perspective, width, height, out_width, out_height, *view)) for name, *view in views]
    return _lookup(spark, maps, out_height, width, height, wrap=True)


def fisheye_lookup(spark: SparkSession, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    half = min(width, height) * 0.5
    unrolled = partial(R.fisheye_equirect, width, height, out_width, out_height, half, half, width * 0.5, height * 0.5)
    return _lookup(spark, [("equirect", unrolled)], out_height, width, height)


def cross5_lookup(spark: SparkSession, width: int, height: int, k: Sequence[float], dist: Sequence[float], size: int) -> DataFrame:
    maps = [(name, partial(R.lens_view, tuple(k), tuple(dist), yaw, pitch, size)) for name, yaw, pitch in R.cross5_views()]
    return _lookup(spark, maps, size, width, height)


def paired_payloads(frames: DataFrame, keys: Sequence[str], lens: str = "lens") -> DataFrame:
    """Rows of lens ``a`` and ``b`` of the same frame side by side."""
    side = lambda p: frames.filter(F.col(lens) == p).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in _SHAPE])
    return side("a").join(side("b"), list(keys))
