"""Metrics of whole frames, one Arrow batch of payloads at a time.

Input rows carry ``data`` (bytes), ``height``, ``width`` and ``channels``. Every job
reads a payload, emits a few numbers and drops the payload, so pixels never
enter a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from reelframe.functions import kernels as N


def _ddl(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def frame_job(
    frames: DataFrame, keys: Sequence[str], kernel: Callable[..., dict[str, float]], fields: Sequence[str]
) -> DataFrame:
    """Apply ``kernel(image) -> {field: float}`` to every frame, keeping only ``keys``."""
    keys, fields = list(keys), list(fields)
    ddl = f"{_ddl(frames, keys)}, " + ", ".join(f"{f} double" for f in fields)

    def run(batches):
        for pdf in batches:
            rows = [
                kernel(N.decode(d, h, w, c))
                for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"], strict=True)
            ]
            out = pdf[keys].copy()
            for f in fields:
                out[f] = [float(r[f]) for r in rows]
            yield out

    return frames.select(*keys, "data", "height", "width", "channels").mapInPandas(run, ddl)


RAW_FIELDS = ("laplacian_var", "tenengrad", "exposure_roi", "black_clip", "white_clip", "contrast", "roi_pixel_count")
LEGACY_FIELDS = ("sharpness", "motion_blur", "exposure_gauss", "softmax_depth")


def raw_quality(
    frames: DataFrame, keys: Sequence[str], *, mode: str = "circle", ratio: float = 0.40, tenengrad_scale: float = 1.0
) -> DataFrame:
    """Region metrics of every frame in one pass over the payloads."""
    return frame_job(
        frames, keys, lambda img: N.raw_metrics(N.to_gray(img), mode, ratio, tenengrad_scale), RAW_FIELDS
    )


def legacy_quality(
    frames: DataFrame, keys: Sequence[str], *, scale: float = 0.5, method: str = "legacy", beta: float | None = 5.0
) -> DataFrame:
    return frame_job(frames, keys, lambda img: N.legacy_metrics(img, scale, method, beta), LEGACY_FIELDS)


def pair_ssim(
    pairs: DataFrame, frames: DataFrame, keys: Sequence[str], *, ref: str = "ref_index", index: str = "frame_index", scale: float = 0.5
) -> DataFrame:
    """Similarity of frame pairs; ``pairs`` decides which payloads meet.

    The payloads of a pair meet by an equi-join on their unique frame keys.
    """
    keys = list(keys)
    shape = ["data", "height", "width", "channels"]
    side = lambda name, p: frames.select(*keys, frames[index].alias(name), *[frames[c].alias(p + c) for c in shape])
    joined = pairs.join(side(ref, "a_"), [*keys, ref]).join(side(index, "b_"), [*keys, index])
    out_cols = [*keys, ref, index]
    ddl = f"{_ddl(joined, out_cols)}, ssim double"

    def run(batches):
        for pdf in batches:
            out = pdf[out_cols].copy()
            out["ssim"] = [
                N.ssim(N.decode(*r[:4]), N.decode(*r[4:]), scale)
                for r in zip(*[pdf[p + c] for p in ("a_", "b_") for c in shape], strict=True)
            ]
            yield out

    cols = [*out_cols, *[p + c for p in ("a_", "b_") for c in shape]]
    return joined.select(*cols).mapInPandas(run, ddl)


def explode_payload(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per pixel of single-channel frames: y, x, v."""
    keys = list(keys)
    ddl = f"{_ddl(frames, keys)}, y int, x int, v double"

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                img = N.to_gray(N.decode(row.data, row.height, row.width, row.channels))
                n = img.size
                out = pd.DataFrame({k: [getattr(row, k)] * n for k in keys})
                out["y"], out["x"] = (a.ravel() for a in np.indices(img.shape))
                out["v"] = img.ravel().astype(float)
                yield out

    return frames.select(*keys, "data", "height", "width", "channels").mapInPandas(run, ddl)
