"""Image kernels on analytic images, and both physical forms of the same operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.functions import kernels as N
from reelframe.functions import projections as R
from reelframe.operators import masks, pixel_tables, pixels, reproject

KEYS = ["video_id", "frame_index"]
DDL = "video_id long, frame_index long, data binary, height int, width int, channels int"


def frames(spark, images):
    rows = [(1, i, bytearray(a.tobytes()), a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2]) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, DDL)


def image(row):
    return N.decode(bytes(row.data), row.height, row.width, row.channels)


GRADIENT = np.tile(np.linspace(0, 255, 320).astype(np.uint8), (240, 1))
CHECKER = (((np.indices((240, 320)) // 20).sum(axis=0) % 2) * 255).astype(np.uint8)
NOISE = np.random.default_rng(42).integers(0, 256, (240, 320)).astype(np.uint8)


def test_flat_image_has_no_edges():
    m = N.raw_metrics(np.full((40, 50), 128, np.uint8), "circle", 0.4)
    assert m["laplacian_var"] == m["tenengrad"] == m["contrast"] == 0.0
    assert m["exposure_roi"] == pytest.approx(0.3)
    assert N.softmax_depth(*N.sobel(np.zeros((9, 9)))) == 0.5


def test_gradient_kernels_on_a_ramp():
    ramp = np.tile(np.arange(30, dtype=float) * 3, (20, 1))
    gx, gy = N.sobel(ramp)
    assert (gx[:, 1:-1] == 24).all() and (gy == 0).all()
    assert (N.laplacian(ramp)[:, 1:-1] == 0).all()
    assert N.direction_imbalance(gx, gy) == 1.0
    assert N.angle_concentration(gx[:, 1:-1], gy[:, 1:-1]) == 1.0


def test_similarity_of_equal_and_different_frames():
    assert N.ssim(CHECKER, CHECKER) == pytest.approx(1.0)
    assert N.ssim(CHECKER, NOISE) < 0.3
    assert N.ssim(CHECKER, CHECKER[:100]) == 0.0


def test_sharper_noise_is_less_blurred():
    soft = N.resize_linear(N.resize_area(NOISE, 60, 80), 240, 320)
    assert N.spectrum_blur(soft) > N.spectrum_blur(NOISE)
    assert N.raw_metrics(NOISE, "rect", 0.6)["laplacian_var"] > N.raw_metrics(soft, "rect", 0.6)["laplacian_var"]


def test_tenengrad_scale_and_colour():
    bgr = np.repeat(GRADIENT[..., None], 3, axis=2)
    assert (N.to_gray(bgr) == GRADIENT).all()
    assert N.raw_metrics(GRADIENT, "circle", 0.4, 0.25)["tenengrad"] > N.raw_metrics(GRADIENT, "circle", 0.4)["tenengrad"]


def test_frame_job_equals_kernel_for_any_partitioning(spark):
    df = frames(spark, [GRADIENT, CHECKER, NOISE])
    one = sorted(pixels.raw_quality(df.repartition(1), KEYS).collect())
    many = sorted(pixels.raw_quality(df.repartition(3), KEYS).collect())
    assert one == many
    assert one[2].laplacian_var == pytest.approx(N.raw_metrics(NOISE, "circle", 0.4)["laplacian_var"])


def test_views_equal_pixel_table_form(spark):
    rng = np.random.default_rng(3)
    df = frames(spark, [rng.integers(0, 256, (8, 16)).astype(np.uint8) for _ in range(2)])
    px = pixels.explode_payload(df, KEYS)
    views = [("v", 40.0, 20.0, 90.0)]
    k, d = (5.0, 0.0, 8.0, 0.0, 5.0, 4.0, 0.0, 0.0, 1.0), (0.1, 0.0, 0.001, 0.002, 0.0)
    cases = [
        (reproject.reproject_cubemap(df, KEYS, 6), reproject.cubemap_lookup(spark, 16, 8, 6)),
        (reproject.reproject_perspective(df, KEYS, views, out_width=7, out_height=5), reproject.perspective_lookup(spark, 16, 8, views, 7, 5)),
        (reproject.fisheye_to_equirect(df, KEYS, out_width=12, out_height=6), reproject.fisheye_lookup(spark, 16, 8, 12, 6)),
        (reproject.split_cross5(df, KEYS, k=k, dist=d, size=6, valid_ratio=0.0, inner_ratio=9.0), reproject.cross5_lookup(spark, 16, 8, k, d, 6)),
    ]
    for whole, lookup in cases:
        table = {(r.frame_index, r.view, r.y, r.x): r.v for r in pixel_tables.reproject(px, lookup, KEYS).collect()}
        for row in whole.collect():
            img = image(row)
            for (y, x), v in np.ndenumerate(img):
                want = table.get((row.frame_index, row.view, y, x), 0.0)
                assert v == 0 or abs(v - want) <= 0.5 + 1e-6


def test_cube_faces_cover_the_sphere():
    face, x, y = R.cube_lookup(64, 64, 32)
    assert set(np.unique(face)) == set(range(len(R.CUBE_FACES)))
    assert min(x.min(), y.min()) >= 0 and max(x.max(), y.max()) <= 63


def test_background_is_the_running_mean_of_the_frames():
    rng = np.random.default_rng(8)
    images = [rng.integers(0, 256, (24, 30), np.uint8) for _ in range(6)]
    moved, mean = np.zeros((24, 30), bool), images[0].astype(float)
    for image_ in images[1:]:
        moved |= np.abs(image_ - mean) > 60
        mean = 0.7 * mean + 0.3 * image_
    assert (N.moving_region(images, 60.0) == N.open_close(moved, N.ellipse(5))).all()


def test_weights_of_the_front_lens():
    w = reproject.front_weights(400)
    assert w[0] == 1 and w[150] == 1 and w[250] == 0 and w[-1] == 0 and w[389] == 1
    assert w[190] == 1 and 0.4 < w[199] < 0.6 and w[200] == 0


def test_faces_back_to_one_frame(spark):
    flat = np.full((32, 64), 90, np.uint8)
    faces = reproject.reproject_cubemap(frames(spark, [flat]), KEYS, 32)
    assert faces.count() == 6
    out = image(reproject.equirect_from_cubemap(faces, KEYS, 64).first())
    assert out.shape == (32, 64) and set(np.unique(out)) <= {0, 89, 90}


def test_blend_and_stitch(spark):
    a, b = np.full((20, 40), 10, np.uint8), np.full((20, 40), 210, np.uint8)
    out = reproject.feather(a, b)
    assert out.shape == (20, 74) and (out[:, :34] == 10).all() and (out[:, 40:] == 210).all()
    assert (np.diff(out[0].astype(int)) >= 0).all()
    assert reproject.feather(a, b, "vertical").shape == (37, 40)
    pair = frames(spark, [a, b]).withColumn("lens", F.when(F.col("frame_index") == 0, "a").otherwise("b")).withColumn("frame_index", F.lit(0))
    whole = image(reproject.stitch_lenses(reproject.paired_payloads(pair, KEYS), KEYS, out_width=40, out_height=20).first())
    assert whole.shape == (20, 40) and whole.max() <= 210
    assert reproject.seam_band(400).sum() == 21


def test_motion_mask_restarts_at_a_gap(spark):
    still = np.zeros((20, 20), np.uint8)
    moved = still.copy()
    moved[5:15, 5:15] = 200
    df = frames(spark, [still, moved, moved, moved]).withColumn("frame_index", F.when(F.col("frame_index") == 3, 9).otherwise(F.col("frame_index")))
    out = {r.frame_index: image(r).sum() for r in masks.motion_mask(df, ["video_id"], history=3, span=4).collect()}
    assert set(out) == {1, 2} and out[1] > 50 and out[2] > 50


def test_inpaint_hook_keeps_frame_on_failure(spark):
    df = frames(spark, [NOISE, CHECKER])
    mask = frames(spark, [np.ones((240, 320), np.uint8)] * 2)

    def hook(img, m):
        if (img == CHECKER).all():
            raise ValueError("no")
        return np.where(m == 1, 0, img)

    out = {r.frame_index: image(r) for r in masks.inpaint(df, mask, KEYS, hook).collect()}
    assert (out[0] == 0).all() and (out[1] == CHECKER).all()


def test_large_lookup_takes_the_salted_join(spark, monkeypatch):
    df = frames(spark, [np.random.default_rng(i).integers(0, 256, (8, 16)).astype(np.uint8) for i in range(3)])
    px, lookup = pixels.explode_payload(df, KEYS), reproject.cubemap_lookup(spark, 16, 8, 4)
    rows = lambda: sorted((r.frame_index, r.view, r.y, r.x, round(r.v, 9)) for r in pixel_tables.reproject(px, lookup, KEYS).collect())
    small = rows()
    monkeypatch.setattr(pixel_tables, "BROADCAST_ROWS", 0)
    assert rows() == small


def test_descriptor_match_over_chunks(spark):
    from reelframe.operators.pairs import descriptor_match

    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2**20, (2, 60))
    bits[1, :20] = bits[0, :20] ^ 1
    rows = [(f, i, int(bits[f, i])) for f in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "frame long, point_id long, bits long")
    pairs = spark.createDataFrame([(0, 1)], "frame_a long, frame_b long")
    want = []
    for i in range(60):
        d = sorted((bin(int(bits[0, i] ^ b)).count("1"), j) for j, b in enumerate(bits[1]))
        if d[0][0] < 0.7 * d[1][0]:
            want.append((i, d[0][1], d[0][0]))
    for chunk in (7, 1000):
        out = descriptor_match(df, pairs, chunk=chunk)
        assert sorted((r.point_a, r.point_b, r.distance) for r in out.collect()) == want


def test_descriptor_match_with_scattered_ids(spark):
    from reelframe.operators.pairs import descriptor_match, point_tiles

    rng = np.random.default_rng(5)
    bits = rng.integers(-(2**62), 2**62, size=(2, 150))
    bits[1, 40:60] = bits[0, 10:30] ^ (1 << rng.integers(0, 60, 20))
    bits[1, 100:110] = bits[1, 40:50]  # ties of the nearest in two tiles
    ids = np.sort(rng.choice(10**9, 150, replace=False))
    rows = [(f, int(i), int(b)) for f in range(2) for i, b in zip(ids, bits[f], strict=True)]
    df = spark.createDataFrame(rows, "frame long, point_id long, bits long")
    assert [len(r.points) for r in point_tiles(df, 32).orderBy("frame", "part").collect()] == [32, 32, 32, 32, 22] * 2
    out = descriptor_match(df, spark.createDataFrame([(0, 1)], "frame_a long, frame_b long"), ratio=0.9, chunk=8, tile=32)
    want = set()
    for i, q in zip(ids, bits[0], strict=True):
        dist = sorted((int(np.bitwise_count(np.int64(q ^ r).view(np.uint64))), int(j)) for j, r in zip(ids, bits[1], strict=True))
        if dist[0][0] < 0.9 * dist[1][0]:
            want.add((0, 1, int(i), dist[0][1], dist[0][0]))
    got = {(r.frame_a, r.frame_b, r.point_a, r.point_b, r.distance) for r in out.collect()}
    assert got == want and len(want) > 9
