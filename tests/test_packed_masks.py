"""Packed masks against plain arrays and the pixel-table form; frames of full size are one row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelframe.operators import packed_masks as PM
from reelframe.operators import pixel_tables as T

KEYS = ["video_id", "frame_index"]


def frames(spark, shapes, seed=0, channels=1):
    rng = np.random.default_rng(seed)
    images = [rng.integers(0, 256, (h, w) if channels == 1 else (h, w, channels), np.uint8) for h, w in shapes]
    rows = [(1, i, a.tobytes(), a.shape[0], a.shape[1], channels) for i, a in enumerate(images)]
    return images, spark.createDataFrame(rows, "video_id long, frame_index long, data binary, height int, width int, channels int")


def masks_of(df):
    return {r.frame_index: PM.unpacked(bytes(r.bits), r.height, r.width) for r in df.collect()}


@pytest.mark.parametrize("kind, ratio", [("fisheye", None), ("fisheye", 0.0), ("polar", 0.2), ("polar", 0.0), ("nadir", None), ("zenith", 0.4)])
def test_regions_equal_the_pixel_table_form(spark, kind, ratio):
    h, w = 23, 37
    px = spark.range(h * w).select((F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    rows = px.withColumn("m", T.region_mask(h, w, kind, ratio)).toPandas().sort_values(["y", "x"])
    assert (PM.removed_region(h, w, kind, ratio) == rows.m.to_numpy(bool).reshape(h, w)).all()


def test_sets_statistics_and_fill(spark):
    images, df = frames(spark, [(5, 7), (64, 64), (1, 1), (9, 16)])
    a, b = PM.mask_where(df, KEYS, lambda v: v > 100), PM.mask_where(df.where("frame_index <> 2"), KEYS, lambda v: v % 2 == 0)
    both, either, first = (masks_of(PM.combine(a, b, KEYS, how)) for how in ("and", "or", "minus"))
    assert sorted(both) == [0, 1, 3] and sorted(either) == sorted(first) == [0, 1, 2, 3]
    for i, v in enumerate(images):
        x, y = v > 100, (v % 2 == 0) if i != 2 else np.zeros_like(v, bool)
        assert (either[i] == (x | y)).all() and (first[i] == (x & ~y)).all()
        assert i == 2 or (both[i] == (x & y)).all()
    for r in PM.mask_stats(a, KEYS).collect():
        m = images[r.frame_index] > 100
        ys, xs = np.nonzero(m)
        assert (r.total_pixels, r.masked_pixels, r.sum_y, r.sum_x) == (m.size, m.sum(), ys.sum(), xs.sum())
    filled = {r.frame_index: np.frombuffer(r.data, np.uint8) for r in PM.fill_masked(df, b, KEYS, fill=9).collect()}
    for i, v in enumerate(images):
        want = np.where(v % 2 == 0, 9, v) if i != 2 else v
        assert (filled[i].reshape(v.shape) == want).all()


def test_fill_of_colours_and_scaled_masks(spark):
    images, df = frames(spark, [(8, 12)], channels=3)
    small = spark.createDataFrame([(1, 0, PM.packed(np.eye(4, dtype=bool)), 4, 4)], "video_id long, frame_index long, bits binary, height int, width int")
    got = np.frombuffer(PM.fill_masked(df, small, KEYS, fill=(1, 2, 3)).first().data, np.uint8).reshape(8, 12, 3)
    mask = np.kron(np.eye(4, dtype=bool), np.ones((2, 3), bool))
    want = images[0].copy()
    want[mask] = (1, 2, 3)
    assert (got == want).all()


def test_boxes_and_instances(spark):
    rng = np.random.default_rng(4)
    sizes = spark.createDataFrame([(1, i, 30, 50) for i in range(4)], "video_id long, frame_index long, height int, width int")
    boxes = pd.DataFrame({"video_id": 1, "frame_index": [0] * 200 + [1] * 3 + [3], "x1": 0.0, "x2": 0.0, "y1": 0.0, "y2": 0.0})
    boxes[["x1", "y1"]] = rng.uniform(-10, 50, (204, 2))
    boxes["x2"], boxes["y2"] = boxes.x1 + rng.uniform(-2, 9, 204), boxes.y1 + rng.uniform(-2, 9, 204)
    got = masks_of(PM.box_masks(spark.createDataFrame(boxes), sizes, KEYS))
    for i in range(4):
        want = np.zeros((30, 50), bool)
        for r in boxes[boxes.frame_index == i].itertuples():
            a, c = max(0, min(int(r.x1), 49)), max(0, min(int(r.y1), 29))
            want[c : max(0, min(int(r.y2), 30)), a : max(0, min(int(r.x2), 50))] = True
        assert (got[i] == want).all()
    parts = [rng.random((30, 50)) < 0.01 for _ in range(40)]
    rows = [(1, 2, PM.packed(p), 30, 50) for p in parts] + [(1, 2, PM.packed(np.ones((3, 3), bool)), 3, 3)]
    made = spark.createDataFrame(rows, "video_id long, frame_index long, bits binary, height int, width int")
    got = masks_of(PM.instance_masks(made, sizes, KEYS))
    assert (got[2] == np.any(parts, axis=0)).all() and not got[0].any()


def test_a_full_size_frame_is_one_row(spark):
    _, df = frames(spark, [(960, 1920)])
    mask = PM.region_masks(df, KEYS, "polar")
    row = mask.first()
    assert mask.count() == 1 and len(row.bits) == 960 * 1920 // 8
    assert PM.mask_stats(mask, KEYS).first().masked_pixels == 2 * 96 * 1920
