"""Block-wise operators against plain sequential loops, with blocks far smaller than the videos."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelframe.operators import pairs as P
from reelframe.operators import motion, nearest, selection, stationary, trajectory
from reelframe.operators.quality import percentile_bounds, quality_gate
from reelframe.plans import blocks as B
from reelframe.plans.chains import follow_chain
from reelframe.plans.percentiles import exact_percentiles

KEYS = ["video_id"]


def make(spark, seed=0, hot=180, videos=4):
    """One video holds most rows, the others are short."""
    rng = np.random.default_rng(seed)
    parts = []
    for v in range(videos):
        n = hot if v == 0 else int(rng.integers(1, 25))
        parts.append(
            pd.DataFrame(
                {
                    "video_id": v,
                    "frame_index": np.arange(n),
                    "timestamp_s": np.arange(n) / 10.0,
                    "score": np.round(rng.random(n), 2),
                    "value": np.round(rng.random(n), 1),
                    "flag": rng.random(n) < 0.6,
                }
            )
        )
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=seed))


def videos(pdf):
    return [(v, g.sort_values("frame_index").reset_index(drop=True)) for v, g in pdf.groupby("video_id")]


def got(df, *cols):
    return sorted(map(tuple, df.select("video_id", *cols).collect()))


@pytest.mark.parametrize("span", [3, 16, 1000])
def test_along_equals_one_pass(spark, span):
    pdf, df = make(spark)
    out = B.along(
        df.withColumn("x", F.when(F.col("flag"), F.col("value"))),
        KEYS,
        ["frame_index"],
        {
            "rs": B.running_sum("value"),
            "rc": B.running_count("flag"),
            "mx": B.running_max("value"),
            "mn": B.following_min("value"),
            "pv": B.previous("x"),
            "nx": B.following("x"),
            "lk": B.last_known("x"),
            "lb": B.last_known_before("x"),
            "nk": B.next_known("x"),
            "na": B.next_known_after("x"),
            "tot": B.total("sum", "value"),
            "tf": B.total_first("value"),
        },
        span=span,
    ).toPandas()
    for v, g in videos(pdf):
        o = out[out.video_id == v].sort_values("frame_index").reset_index(drop=True)
        x = g.value.where(g.flag)
        want = {
            "rs": g.value.cumsum(),
            "rc": g.flag.cumsum(),
            "mx": g.value.cummax(),
            "mn": g.value[::-1].cummin()[::-1],
            "pv": x.shift(1),
            "nx": x.shift(-1),
            "lk": x.ffill(),
            "lb": x.ffill().shift(1),
            "nk": x.bfill(),
            "na": x.bfill().shift(-1),
            "tot": pd.Series(g.value.sum(), index=g.index),
            "tf": pd.Series(g.value.iloc[0], index=g.index),
        }
        for name, series in want.items():
            np.testing.assert_allclose(o[name].astype(float), series.astype(float), atol=1e-9, err_msg=f"{v} {name}")


def test_assign_index_with_ties_in_time(spark):
    pdf, df = make(spark, 3)
    out = B.assign_index(df, KEYS, ["value", "frame_index"], "n").toPandas()
    for v, g in videos(pdf):
        want = g.sort_values(["value", "frame_index"]).frame_index.tolist()
        assert out[out.video_id == v].sort_values("n").frame_index.tolist() == want
        assert sorted(out[out.video_id == v].n) == list(range(len(g)))


@pytest.mark.parametrize("small", [0, 30, 10_000])
def test_percentiles_match_numpy(spark, small):
    pdf, df = make(spark, 5)
    df = df.withColumn("score", F.when(F.col("frame_index") == 7, float("nan")).otherwise(F.col("score")))
    out = exact_percentiles(df, KEYS, ["score", "value"], [0.0, 0.1, 0.5, 0.95, 1.0], small=small).collect()
    for row in out:
        g = pdf[pdf.video_id == row.video_id]
        score = g.score[g.frame_index != 7]
        for i, p in enumerate([0.0, 0.1, 0.5, 0.95, 1.0]):
            assert row[f"score_p{i}"] == pytest.approx(np.quantile(score, p), abs=1e-12)
            assert row[f"value_p{i}"] == pytest.approx(np.quantile(g.value, p), abs=1e-12)


def test_percentiles_of_a_large_group(spark):
    df = spark.range(60_000).select(F.lit(1).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(9973)) / 7.0).alias("x"))
    x = df.toPandas().x.to_numpy()
    row = exact_percentiles(df, ["k"], ["x"], [0.1, 0.5, 0.9], small=1000).first()
    for i, p in enumerate([0.1, 0.5, 0.9]):
        assert row[f"x_p{i}"] == pytest.approx(np.quantile(x, p), abs=1e-9)


@pytest.mark.parametrize("shape", ["normal", "powers", "two values", "equal", "extremes", "few finite"])
def test_narrowing_finds_every_rank(spark, shape):
    rng = np.random.default_rng(5)
    n = 5000
    x = {
        "normal": rng.normal(size=n),
        "powers": np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n),
        "two values": rng.choice([0.1, np.nextafter(0.1, 1)], n),
        "equal": np.full(n, 7.5),
        "extremes": rng.choice([-1.7e308, 1.7e308, 5e-324, 0.0, -5e-324], n),
        "few finite": np.where(rng.random(n) < 0.01, rng.random(n), np.nan),
    }[shape]
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 5 == 0, 2, 1), "x": x, "y": rng.random(n)})
    pdf = pd.concat([pdf, pd.DataFrame({"k": 3, "x": [1.0, 2.0], "y": [np.nan, 4.0]})])
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    rows = exact_percentiles(spark.createDataFrame(pdf), ["k"], ["x", "y"], probs, small=40).collect()
    assert sorted(r.k for r in rows) == [1, 2, 3]
    for r in rows:
        for c in "xy":
            v = pdf[pdf.k == r.k][c].dropna().to_numpy()
            assert r[f"{c}_n"] == len(v)
            for i, p in enumerate(probs):
                h = p * (len(v) - 1)
                v.sort()
                a, b = v[int(np.floor(h))], v[int(np.ceil(h))]
                assert r[f"{c}_p{i}"] == pytest.approx(a + (b - a) * (h - np.floor(h)), rel=1e-12)


def sequential_nms(g, window):
    kept = []
    for _, r in g.sort_values(["score", "frame_index"], ascending=[False, True]).iterrows():
        if all(abs(r.timestamp_s - t) >= window for _, t in kept):
            kept.append((int(r.frame_index), r.timestamp_s))
    return sorted(i for i, _ in kept)


SHAPES = {
    "random": lambda g, rng: rng.random(len(g)).round(2),
    "rising": lambda g, rng: g.frame_index / 1000.0,
    "falling": lambda g, rng: -g.frame_index / 1000.0,
    "rising with noise": lambda g, rng: g.frame_index / 100.0 + rng.random(len(g)) * 0.09,
    "waves": lambda g, rng: np.sin(g.frame_index / 40.0) + rng.random(len(g)) * 0.01,
    "equal": lambda g, rng: g.frame_index * 0.0,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_nms_equals_greedy_loop(spark, shape):
    pdf, _ = make(spark, 11, hot=600)
    pdf["score"] = SHAPES[shape](pdf, np.random.default_rng(3)).astype(float)
    df = spark.createDataFrame(pdf)
    from reelframe.plans.chains import greedy_suppress

    slim = df.select("video_id", F.col("frame_index").alias("idx"), F.col("timestamp_s").alias("t"), "score")
    rounds = []
    out = greedy_suppress(slim, KEYS, 0.7, block_seconds=5.6, span=64, rounds=rounds)
    want = [(v, i) for v, g in videos(pdf) for i in sequential_nms(g, 0.7)]
    assert got(out, "idx") == sorted(want)
    assert len(rounds) <= 5


@pytest.mark.parametrize("noise", [0.0, 0.5])
def test_nms_of_rising_scores_takes_few_rounds(spark, noise):
    """256 blocks of which each hangs on the next one; rounds and written rows stay few."""
    from reelframe.plans.chains import greedy_suppress

    n = 256 * 16
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"video_id": 1, "idx": np.arange(n), "t": np.arange(n) / 2.0, "score": np.arange(n) + noise * rng.random(n)})
    rounds = []
    out = greedy_suppress(spark.createDataFrame(pdf), KEYS, 1.0, block_seconds=8.0, rounds=rounds)
    want = sequential_nms(pdf.rename(columns={"idx": "frame_index", "t": "timestamp_s"}), 1.0)
    assert [i for _, i in got(out, "idx")] == want
    assert len(rounds) <= 5 and sum(rounds) <= 3 * n


def test_min_interval_equals_loop(spark):
    pdf, df = make(spark, 2)
    out = selection.min_interval_select(df.filter("flag"), KEYS, 5, span=8)
    want = []
    for v, g in videos(pdf):
        last = None
        for i in g.frame_index[g.flag]:
            if last is None or i - last >= 5:
                want.append((v, i))
                last = i
    assert got(out, "frame_index") == sorted(want)


def test_chain_recursion_over_levels(spark, monkeypatch):
    from reelframe.plans import chains

    monkeypatch.setattr(chains, "FOLD_ROWS", 6)
    monkeypatch.setattr(chains, "BLOCKS_PER_LEVEL", 4)
    nodes = spark.range(200).select(
        F.lit(1).alias("video_id"),
        F.col("id").alias("idx"),
        F.when(F.col("id") + 7 < 200, F.col("id") + 3 + F.col("id") % 4).alias("next_idx"),
        (F.col("id") == 0).alias("is_start"),
    )
    reached, i = [], 0
    while True:
        reached.append((1, i))
        if i + 7 >= 200:
            break
        i = i + 3 + i % 4
    assert got(follow_chain(nodes, KEYS, span=5), "idx") == reached


def test_fill_max_interval_equals_loop(spark):
    pdf, df = make(spark, 8)
    kf = df.filter("frame_index % 37 = 0")
    out = selection.fill_max_interval(kf, df.filter("flag"), KEYS, max_seconds=0.75, span=16)
    want = []
    for v, g in videos(pdf):
        keys = g[g.frame_index % 37 == 0]
        pool = g[g.flag]
        chosen = [keys.iloc[0]]
        for _, cur in keys.iloc[1:].iterrows():
            while cur.timestamp_s - chosen[-1].timestamp_s > 0.75:
                last = chosen[-1]
                used = [c.frame_index for c in chosen]
                between = pool[(pool.frame_index > last.frame_index) & (pool.frame_index < cur.frame_index) & ~pool.frame_index.isin(used)]
                if between.empty:
                    break
                gap = (between.timestamp_s - (last.timestamp_s + 0.75)).abs()
                best = between.assign(gap=gap, neg=-between.score).sort_values(["gap", "neg", "frame_index"]).iloc[0]
                chosen.append(best)
            chosen.append(cur)
        want += [(v, int(c.frame_index)) for c in chosen]
    assert got(out, "frame_index") == sorted(want)


@pytest.mark.parametrize("exposure", [None, 0.5])
def test_keyframe_chain_equals_loop(spark, exposure):
    pdf, df = make(spark, 21, hot=120)
    df = df.withColumnRenamed("value", "brightness").withColumn("content", F.floor(F.col("frame_index") / 23) % 3)

    def similarity(pairs):
        ref = df.select("video_id", F.col("frame_index").alias("ref_index"), F.col("content").alias("rc"))
        cur = df.select("video_id", "frame_index", F.col("content").alias("cc"))
        out = pairs.join(ref, ["video_id", "ref_index"]).join(cur, ["video_id", "frame_index"])
        return out.withColumn("ssim", F.when(F.col("rc") == F.col("cc"), 1.0).otherwise(0.0)).drop("rc", "cc")

    out = selection.keyframe_chain(
        df.filter("flag"), similarity, KEYS, min_interval=3, horizon=5, exposure_threshold=exposure, span=16
    )
    want = []
    for v, g in videos(pdf):
        last = bright = None
        for _, r in g[g.flag].iterrows():
            i = int(r.frame_index)
            if last is not None and i - last < 3:
                continue
            jumped = exposure is not None and bright is not None and abs(r.value - bright) > exposure
            bright = r.value
            if last is not None and (i // 23) % 3 == (last // 23) % 3 and not jumped:
                continue
            want.append((v, i))
            last = i
    assert got(out, "frame_index") == sorted(want)


def test_hysteresis_and_runs_equal_loop(spark):
    pdf, df = make(spark, 4)
    df = df.withColumns({"translation": F.col("value"), "rotation": F.lit(0.0), "flow_mag": F.col("score"), "match_count": F.lit(99.0)})
    th = spark.createDataFrame([(v, 0.5, 0.1, 0.5) for v in range(4)], "video_id long, translation_th double, rotation_th double, flow_mag_th double")
    out = stationary.stationary_hysteresis(df, th, KEYS)
    out = stationary.drop_short_runs(out, KEYS, min_rows=2)
    want = []
    for v, g in videos(pdf):
        on, flags = False, []
        for _, r in g.iterrows():
            scale = 1.25 if on else 1.0
            on = bool(r.value <= 0.5 * scale and r.score <= 0.5 * scale)
            flags.append(on)
        runs = pd.Series(flags)
        length = runs.groupby((runs != runs.shift()).cumsum()).transform("size")
        want += [(v, i, bool(f and n >= 2)) for i, (f, n) in enumerate(zip(runs, length))]
    assert got(out, "frame_index", "is_stationary") == sorted(want)


@pytest.mark.parametrize("span", [7, 64])
def test_grace_and_rescue_blocks(spark, span):
    pdf, df = make(spark, 6)
    edge = stationary.boundary_grace(df.withColumnRenamed("flag", "is_stationary"), KEYS, span=span)
    rescue = motion.rescue_mode(df.withColumn("match_count", F.col("score") * 30), KEYS, "frame_index", window=6, threshold=15.003, span=span)
    want_edge, want_rescue = [], []
    for v, g in videos(pdf):
        f = g.flag.tolist()
        edges = [i for i in range(len(f)) if f[i] and (i == 0 or not f[i - 1] or i + 1 == len(f) or not f[i + 1])]
        want_edge += [(v, i, any(abs(i - e) <= 2 for e in edges)) for i in range(len(f))]
        mean = (g.score * 30).rolling(6).mean()
        want_rescue += [(v, i, bool(m < 15.003)) for i, m in enumerate(mean)]
    assert got(edge, "frame_index", "is_boundary") == sorted(want_edge)
    assert got(rescue, "frame_index", "is_rescue_mode") == sorted(want_rescue)


def test_nearest_tie_goes_left_and_empty_side(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (1, 99), (2, 3)], "video_id long, frame_index long")
    right = spark.createDataFrame([(1, 4, "a"), (1, 6, "b"), (1, 40, "c")], "video_id long, frame_index long, name string")
    out = nearest.nearest_join(left, right, KEYS, "frame_index", dense=True)
    assert got(out, "frame_index", "r_name", "gap") == [(1, 0, "a", 4), (1, 5, "a", 1), (1, 99, "c", 59), (2, 3, None, None)]


def sequential_poses(g):
    def matrix(q):
        n = np.linalg.norm(q)
        if n <= 1e-12:
            return np.eye(3)
        w, x, y, z = q / n
        return np.array(
            [
                [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
                [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
                [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
            ]
        )

    valid = [s for s, ok in zip(g.step, g.ok) if ok and s > 0]
    median = np.median(valid) if valid else 1.0
    r, p, out = np.eye(3), np.zeros(3), []
    for q, t, s, ok in zip(g.q, g.t, g.step, g.ok):
        if ok:
            r = r @ matrix(q)
            n = np.linalg.norm(t)
            if n > 1e-12:
                p = p + max(0.0, s) / median * (r @ (t / n))
        out.append((p.copy(), r.copy()))
    return out


@pytest.mark.parametrize("span", [5, 512])
def test_integrated_poses_equal_loop(spark, span):
    from reelframe.functions.pose import matrix_from_quaternion

    pdf, _ = make(spark, 9)
    rng = np.random.default_rng(1)
    pdf["q"] = list(rng.normal(size=(len(pdf), 4)))
    pdf["t"] = list(rng.normal(size=(len(pdf), 3)))
    pdf.at[3, "t"], pdf.at[5, "q"] = np.zeros(3), np.zeros(4)
    pdf["step"], pdf["ok"] = rng.random(len(pdf)) * 9, pdf.flag
    df = spark.createDataFrame(pdf.assign(q=pdf.q.map(list), t=pdf.t.map(list)))
    df = df.select("video_id", "frame_index", F.col("ok").alias("vo_valid"), F.col("q").alias("q_rel"), F.col("t").alias("t_dir"), F.col("step").alias("step_proxy"))
    out = trajectory.integrate_trajectory(df, KEYS, span=span).withColumn("m", matrix_from_quaternion("q_wxyz")).toPandas()
    for v, g in videos(pdf):
        o = out[out.video_id == v].sort_values("frame_index")
        want = sequential_poses(g)
        np.testing.assert_allclose(np.stack(o.t_xyz), [p for p, _ in want], atol=1e-9)
        np.testing.assert_allclose(np.stack(o.m), [r.ravel() for _, r in want], atol=1e-9)


def test_gate_is_the_same_alone_and_among_many(spark):
    pdf, df = make(spark, 13)
    df = df.select("video_id", "frame_index", (F.col("score") * 90).alias("laplacian_var"), F.col("value").alias("tenengrad"), F.col("score").alias("exposure"), F.col("frame_index").alias("orb_keypoints"))
    cols = ("frame_index", "quality", "drop_reason")
    alone = quality_gate(df.filter("video_id = 0").repartition(1))
    assert [r for r in got(quality_gate(df), *cols) if r[0] == 0] == got(alone, *cols)


def test_gate_edge_cases(spark):
    flat = spark.createDataFrame([(1, i, 50.0, 5.0, 0.5, 3.0) for i in range(4)], "video_id long, frame_index long, laplacian_var double, tenengrad double, exposure double, orb_keypoints double")
    assert {r.quality for r in quality_gate(flat).collect()} == {0.5}
    empty = percentile_bounds(flat.withColumn("exposure", F.lit(float("nan"))), KEYS).first()
    assert (empty.exposure_low, empty.exposure_high) == (0.0, 1.0)
    strict = quality_gate(flat, threshold=0.9).filter("is_pass").count()
    assert strict <= quality_gate(flat, threshold=0.1).filter("is_pass").count()


def _fill(spark, candidates):
    from reelframe.operators.selection import fill_max_interval

    schema = "video_id long, frame_index long, timestamp_s double, score double"
    keyframes = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 9, 9.0, 1.0)], schema)
    rows = spark.createDataFrame([(1, i, t, s) for i, t, s in candidates], schema)
    out = fill_max_interval(keyframes, rows, ["video_id"], max_seconds=3.0, span=4)
    return sorted(r.frame_index for r in out.collect() if r.frame_index not in (0, 9))


def test_fill_takes_the_better_of_equal_times(spark):
    assert _fill(spark, [(1, 3.0, 0.2), (2, 3.0, 0.9)]) == [2]
    assert _fill(spark, [(2, 3.0, 0.9), (1, 3.0, 0.2)]) == [2]
    assert _fill(spark, [(1, 3.0, 0.9), (2, 3.0, 0.2)]) == [1]
    assert _fill(spark, [(1, 3.0, 0.5), (2, 3.0, 0.5)]) == [1]


def test_rows_without_key_are_a_sequence_of_their_own(spark):
    from pyspark.sql import functions as F

    from reelframe.plans.blocks import along, assign_index, running_sum
    from reelframe.plans.percentiles import exact_percentiles

    rows = [(None if i % 4 == 0 else i % 4, i // 4, float(i)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, i long, v double")
    for span in (16, 1 << 16):
        out = along(df, ["k"], ["i"], {"s": running_sum("v")}, span=span)
        assert out.where("k IS NULL").agg(F.max("s")).first()[0] == sum(v for k, _, v in rows if k is None)
        assert out.count() == 4000
    numbered = assign_index(df.drop("i"), ["k"], ["v"])
    assert sorted(r.frame_index for r in numbered.where("k IS NULL").collect()) == list(range(1000))
    few = exact_percentiles(df, ["k"], ["v"], [0.1, 0.5], small=100_000)
    many = exact_percentiles(df, ["k"], ["v"], [0.1, 0.5], small=100)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, few.collect()), key=key) == sorted(map(tuple, many.collect()), key=key)
    assert few.count() == 4


def test_percentiles_are_the_same_bits_for_small_and_large_groups(spark):
    values = np.round(np.random.default_rng(3).uniform(0, 40, 3000), 1)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000) % 40, "v": values}))
    probs = [0.1, 0.37, 0.6, 0.95]
    rows = lambda small: sorted(tuple(r) for r in exact_percentiles(df, ["k"], ["v"], probs, small=small).collect())
    assert rows(10) == rows(100_000)


def test_band_pairs_carry_columns_of_the_earlier_frame(spark):
    rows = [(v, i, float(i * i + v)) for v in (1, 2) for i in range(25) if i % 4]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, x double")
    pairs = P.band_pairs(df, ["video_id"], nearest=2, furthest=6, ref_columns={"x": "ref_x"})
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    want = {(v, a, b, y, x) for v, a, x in rows for u, b, y in rows if v == u and 2 <= b - a <= 6}
    assert {(r.video_id, r.ref_index, r.frame_index, r.x, r.ref_x) for r in pairs.collect()} == want


def test_task_groups_keep_their_partitions(spark):
    """Groups of few bytes may be long work, so they are not merged into one partition by their size."""
    from pyspark import TaskContext
    from reelframe.plans.blocks import in_tasks

    df = spark.range(4000).withColumn("video_id", F.col("id") % 500)

    def place(pdf):
        return pd.DataFrame({"place": [TaskContext.get().partitionId()], "rows": [len(pdf)]})

    found = in_tasks(df, ["video_id"], rows=100).applyInPandas(place, "place int, rows long").collect()
    assert sum(r["rows"] for r in found) == 4000 and len({r["place"] for r in found}) > 8
    assert max(r["rows"] for r in found) < 400


@pytest.mark.parametrize("seed", range(4))
def test_suppression_of_many_units_in_one_call(seed):
    """Units of a call don't touch one another, whatever their times; ties, null times and rows kept before included."""
    from reelframe.plans.chains import _suppress_blocks

    rng = np.random.default_rng(seed)
    n, window = 200, 1.0
    t = np.round(rng.random(n) * 20, 1)
    t[:3] = np.nan
    rows = pd.DataFrame({"video_id": rng.choice([1.0, 2.0, np.nan], n), "_block": 0, "_home": 0, "idx": rng.permutation(n), "t": t})
    rows["score"], rows["kept"] = np.round(rng.random(n), 1), False
    want = []
    for _, part in rows.groupby("video_id", dropna=False):
        taken = []
        for r in part.sort_values(["score", "idx"], ascending=[False, True]).itertuples():
            if all(not abs(r.t - k) < window for k in taken):
                taken.append(r.t)
                want.append(r.idx)
    got = _suppress_blocks(rows, ["video_id", "_block"], window)
    assert sorted(got["idx"]) == sorted(want) and got["kept"].all()


@pytest.mark.parametrize("hot_rows", [0, 100, 1 << 16])
def test_attach_copies_hot_keys_only(spark, hot_rows):
    """Rows of long and short keys, null keys and keys without a value; only keys of many rows are copied."""
    pdf = pd.DataFrame({"video_id": [1] * 400 + [None] * 300 + [2] * 5 + [3] * 2, "frame_index": range(707)})
    df = spark.createDataFrame(pdf, "video_id double, frame_index long")
    per_key = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "n"), (9.0, "z")], "video_id double, value string")
    seen = spark.sparkContext.accumulator(0)

    def counted(parts):
        for part in parts:
            seen.add(part.num_rows)
            yield part

    out = B.attach(df, per_key, ["video_id"], F.col("frame_index"), hot_rows=hot_rows, copies=8)
    got = {(r[0], r[2]) for r in out.collect()}
    assert out.count() == 707 and got == {(1.0, "a"), (None, "n"), (2.0, "b"), (3.0, None)}
    inner = B.attach(df, per_key.mapInArrow(counted, per_key.schema), ["video_id"], F.col("frame_index"), how="inner", hot_rows=hot_rows, copies=8)
    assert inner.count() == 705 and seen.value == 4


def test_attach_makes_no_copies_for_short_videos(spark):
    df = spark.range(3000).withColumn("video_id", F.col("id") % 600)
    per_key = df.groupBy("video_id").agg(F.max("id").alias("last"))
    plan = B.attach(df, per_key, ["video_id"], F.col("id"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
