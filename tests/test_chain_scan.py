"""The keyframe scan against a frame-by-frame loop, with blocks far smaller than the videos."""

import numpy as np
import pandas as pd
import pytest
from pyspark import AccumulatorParam, TaskContext

from reelframe.operators.chain_scan import ChainRules, keyframe_scan

KEYS = ["video_id"]


def make(seed, hot=400, videos=4, distinct=0):
    rng = np.random.default_rng(seed)
    parts = []
    for v in range(videos):
        n = hot if v == 0 else int(rng.integers(1, 30))
        at = np.sort(rng.choice(n * 2, n, replace=False))
        content = np.arange(n) if distinct else (np.arange(n) // int(rng.integers(2, 30))) % 3
        parts.append(
            pd.DataFrame(
                {
                    "video_id": v if v else None,
                    "frame_index": at,
                    "brightness": np.round(rng.random(n), 1),
                    "content": content.astype(float),
                    "noise": rng.integers(0, 40, n).astype(float),
                    "other": "x",
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def compared(ref, rows):
    """Similarity, match count and outcome of pairs, any function of the two frames."""
    same = rows["content"] == ref["content"]
    sum_ = rows["noise"] + ref["noise"]
    kind = (rows["noise"] * 7 + ref["noise"] * 3) % 11
    status = np.where(kind < 3, "failed", np.where(kind == 3, "degenerate", "ok"))
    return {"ssim": np.where(same, 0.9, 0.2), "match_count": sum_, "status": status}


def similar_only(ref, rows):
    return {"ssim": compared(ref, rows)["ssim"]}


def loop(pdf, rules, with_matches):
    out, met = [], 0
    for v, g in pdf.groupby("video_id", dropna=False):
        key, bright, history, rescue = None, None, [], False
        for r in g.sort_values("frame_index").to_dict("records"):
            if key is not None and r["frame_index"] - key["frame_index"] < rules.min_interval:
                continue
            jumped = rules.exposure_threshold is not None and bright is not None and abs(r["brightness"] - bright) > rules.exposure_threshold
            bright = r["brightness"]
            ssim, forced = None, False
            if key is not None:
                met += 1
                pair = compared(key, {c: np.array([v]) for c, v in r.items()})
                ssim = pair["ssim"][0]
                if with_matches:
                    status = pair["status"][0]
                    if status != "degenerate" and rules.rescue_window:
                        history = (history + [0.0 if status == "failed" else pair["match_count"][0]])[-rules.rescue_window :]
                        rescue = len(history) == rules.rescue_window and sum(history) / len(history) < rules.rescue_threshold
                    if status == "failed":
                        if not rescue:
                            continue
                        forced = True
                if ssim > rules.ssim_threshold and not forced and not jumped:
                    continue
            out.append((None if pd.isna(v) else int(v), r["frame_index"], key and key["frame_index"], ssim, rescue, forced or jumped))
            key = r
    return sorted(out, key=str), met


def scanned(df, score, rules, **settings):
    rows = keyframe_scan(df, score, KEYS, columns=["content", "noise"], rules=rules, **settings).collect()
    return sorted((tuple(r) for r in rows), key=str)


RULES = [
    ChainRules(min_interval=3),
    ChainRules(min_interval=4, exposure_threshold=0.5),
    ChainRules(min_interval=3, exposure_threshold=0.6, rescue_window=3, rescue_threshold=30.0),
    ChainRules(min_interval=2, rescue_window=2, rescue_threshold=45.0),
]


@pytest.mark.parametrize("k, span", [(0, 16), (1, 64), (2, 16), (3, 1 << 16)])
def test_equals_loop(spark, k, span):
    rules, with_matches = RULES[k], k >= 2
    pdf = make(k)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=k), "video_id long, frame_index long, brightness double, content double, noise double, other string")
    want, _ = loop(pdf, rules, with_matches)
    assert scanned(df, compared if with_matches else similar_only, rules, span=span) == want


def test_phases_that_never_meet(spark):
    """Every frame differs, so scans with different starts never fall in with one another."""
    pdf = make(9, hot=300, videos=1, distinct=1).assign(video_id=1, frame_index=range(300))
    df = spark.createDataFrame(pdf)
    rules = ChainRules(min_interval=7)
    assert [r[1] for r in sorted(scanned(df, similar_only, rules, span=20), key=lambda r: r[1])] == list(range(0, 300, 7))


@pytest.mark.parametrize("span, most", [(1 << 16, 2.0), (64, 6.0)])
def test_pairs_scored_are_few(spark, span, most):
    """At most so many times the pairs a loop meets; the whole band would be 57 a frame."""
    pdf = make(5, hot=3000, videos=1).assign(video_id=1)
    df = spark.createDataFrame(pdf)
    count = spark.sparkContext.accumulator(0)

    def counted(ref, rows):
        count.add(len(rows["idx"]))
        return similar_only(ref, rows)

    rules = ChainRules(min_interval=3)
    want, met = loop(pdf, rules, False)
    got = scanned(df, counted, rules, span=span, lookahead=1)
    assert got == want and met <= count.value <= most * met


def test_empty_and_single(spark):
    pdf = make(1, hot=1, videos=1)
    df = spark.createDataFrame(pdf, "video_id long, frame_index long, brightness double, content double, noise double, other string")
    assert len(scanned(df, similar_only, RULES[0])) == 1
    assert scanned(df.limit(0), similar_only, RULES[0]) == []


@pytest.mark.parametrize("k, task_rows", [(0, 64), (1, 256), (2, 64), (3, 512)])
def test_equals_loop_over_several_stretches(spark, k, task_rows):
    rules, with_matches = RULES[k], k >= 2
    pdf = make(20 + k)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=k), "video_id long, frame_index long, brightness double, content double, noise double, other string")
    want, _ = loop(pdf, rules, with_matches)
    assert scanned(df, compared if with_matches else similar_only, rules, span=16, task_rows=task_rows) == want


def test_small_blocks_of_a_stretch_are_scanned_about_once(spark):
    """Blocks behind the first of a stretch are entered with what leaves the one before, so most starts are not scanned."""
    pdf = make(5, hot=3000, videos=1).assign(video_id=1)
    df = spark.createDataFrame(pdf)
    count = spark.sparkContext.accumulator(0)

    def counted(ref, rows):
        count.add(len(rows["idx"]))
        return similar_only(ref, rows)

    rules = ChainRules(min_interval=3)
    want, met = loop(pdf, rules, False)
    assert scanned(df, counted, rules, span=48, lookahead=1) == want and met <= count.value <= 2 * met


class _Union(AccumulatorParam):
    def zero(self, value):
        return set()

    def addInPlace(self, a, b):
        return a | b


def test_short_videos_spread_over_tasks(spark):
    """Few bytes take long to scan, so partitions must not be merged by their size."""
    pdf = pd.concat([make(v, hot=60, videos=1).assign(video_id=v) for v in range(40)])
    places = spark.sparkContext.accumulator(set(), _Union())

    def placed(ref, rows):
        places.add({TaskContext.get().partitionId()})
        return similar_only(ref, rows)

    assert scanned(spark.createDataFrame(pdf), placed, RULES[0], span=48)
    assert len(places.value) > 4
