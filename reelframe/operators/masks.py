"""Masks from motion and detections, and the inpaint hook."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions import kernels as N
from reelframe.plans.blocks import with_halo

_SHAPE = ["data", "height", "width", "channels"]


def motion_mask(
    frames: DataFrame,
    keys: Sequence[str],
    index: str = "frame_index",
    *,
    history: int = 5,
    threshold: float = 30.0,
    dilation: int = 0,
    span: int = 16,
) -> DataFrame:
    """Mask of moving pixels per frame, from the frame and up to ``history - 1`` before it.

    The history restarts where the index jumps by more than one; frames without
    a predecessor have no mask. ``index`` is a dense row number, and blocks are short
    because every row carries a payload. Output payloads are 0/1 bytes.
    """
    keys = list(keys)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in [*keys, index])
    placed = with_halo(frames.select(*keys, index, *_SHAPE), index, history - 1, 0, span=span)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(index, ignore_index=True)
        images: list[np.ndarray] = []
        out, last = [], None
        for row in pdf.itertuples(index=False):
            r = dict(zip(pdf.columns, row, strict=True))
            if last is not None and r[index] - last > 1:
                images = []
            last = r[index]
            img = N.decode(r["data"], r["height"], r["width"], r["channels"])
            images = [i for i in images if i.shape[:2] == img.shape[:2]][-(history - 1) :] + [img]
            if r["_home"] != r["_block"] or len(images) < 2:
                continue
            mask = N.moving_region(images, threshold)
            if dilation > 0:
                mask = N.dilate(mask, N.ellipse(dilation))
            out.append([*[r[k] for k in keys], r[index], mask.astype(np.uint8).tobytes(), *mask.shape, 1])
        return pd.DataFrame(out, columns=[*keys, index, *_SHAPE])

    return placed.groupBy(*keys, "_block").applyInPandas(
        run, f"{types}, data binary, height int, width int, channels int"
    )


def box_cells(detections: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """Pixels covered by the clamped boxes of each frame."""
    whole = lambda c: F.col(c).cast("int")
    lo = lambda c, size: F.greatest(F.lit(0), F.least(whole(c), F.lit(size - 1)))
    hi = lambda c, size: F.greatest(F.lit(0), F.least(whole(c), F.lit(size)))
    boxes = detections.select(
        *keys, lo("x1", width).alias("a"), hi("x2", width).alias("b"), lo("y1", height).alias("c"), hi("y2", height).alias("d")
    ).filter("b > a AND d > c")
    return (
        boxes.select(*keys, "a", "b", F.explode(F.expr("sequence(c, d - 1)")).alias("y"))
        .select(*keys, "y", F.explode(F.expr("sequence(a, b - 1)")).alias("x"))
        .distinct()
    )


def detections_to_mask(pixels: DataFrame, detections: DataFrame, keys: Sequence[str], width: int, height: int) -> DataFrame:
    """0 on detected objects, 255 elsewhere, for every pixel of ``pixels``."""
    hit = box_cells(detections, keys, width, height).withColumn("_hit", F.lit(True))
    out = pixels.join(hit, [*keys, "y", "x"], "left")
    return out.withColumn("mask", F.when(F.col("_hit"), 0).otherwise(255)).drop("_hit")


def inpaint(
    frames: DataFrame, masks: DataFrame, keys: Sequence[str], hook: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """Pass each frame and its mask to ``hook``; a failing hook leaves the frame as it is."""
    keys = list(keys)
    joined = frames.select(*keys, *_SHAPE).join(masks.select(*keys, F.col("data").alias("mask")), keys, "left")
    cols = [*keys, *_SHAPE]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in cols)

    def patch(data, height, width, channels, mask):
        if mask is None:
            return data
        img = N.decode(data, height, width, channels)
        try:
            out = np.asarray(hook(img, N.decode(mask, height, width, 1)))
        except Exception:
            return data
        return out.astype(np.uint8).tobytes() if out.shape == img.shape else data

    def run(batches):
        for pdf in batches:
            out = pdf[cols].copy()
            out["data"] = [patch(*r) for r in zip(*[pdf[c] for c in [*_SHAPE, "mask"]], strict=True)]
            yield out

    return joined.select(*cols, "mask").mapInPandas(run, ddl)
