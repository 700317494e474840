"""Keyframe selection: suppression, gap filling, spacing, chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators.nearest import neighbours
from reelframe.operators.pairs import band_pairs
from reelframe.plans.blocks import (
    BLOCK_ROWS,
    along,
    assign_index,
    join_same,
    last_known,
    next_known,
    next_known_after,
    previous,
)
from reelframe.plans.chains import follow_chain, greedy_suppress
from reelframe.session import written_table

# Default spacing of keyframes and the similarity above which a frame is skipped.
MIN_INTERVAL, MAX_INTERVAL, SSIM_THRESHOLD, NMS_WINDOW = 5, 60, 0.85, 1.0


def nms(
    df: DataFrame,
    keys: Sequence[str],
    *,
    window: float = NMS_WINDOW,
    index: str = "frame_index",
    time: str = "timestamp_s",
    score: str = "score",
) -> DataFrame:
    """Keep the best candidates that are at least ``window`` seconds apart."""
    slim = df.select(*keys, F.col(index).alias("idx"), F.col(time).alias("t"), F.col(score).alias("score"))
    kept = greedy_suppress(slim, keys, window).withColumnRenamed("idx", index)
    return df.join(kept, [*keys, index], "left_semi")


def fill_max_interval(
    keyframes: DataFrame,
    candidates: DataFrame,
    keys: Sequence[str],
    *,
    max_seconds: float,
    index: str = "frame_index",
    time: str = "timestamp_s",
    score: str = "score",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Fill gaps longer than ``max_seconds`` with the candidates nearest to the wanted times.

    Which candidate follows a row depends only on that row and the next keyframe,
    so the insertions are a chain of pointers that starts at every keyframe.
    """
    keys = list(keys)
    slim = lambda d: d.select(*keys, F.col(index).alias("idx"), F.col(time).alias("t"), F.col(score).alias("score"))
    nodes = (
        slim(candidates)
        .withColumn("is_start", F.lit(False))
        .unionByName(slim(keyframes).withColumn("is_start", F.lit(True)))
        .groupBy(*keys, "idx")
        .agg(F.first("t").alias("t"), F.first("score").alias("score"), F.bool_or("is_start").alias("is_start"))
    )
    nodes = written_table(nodes, "nodes")
    end = F.when(F.col("is_start"), F.struct("idx", "t"))
    ended = along(nodes, keys, ["idx"], {"end": next_known_after(end)}, span=span).withColumn("gap_end", F.col("end.idx"))
    ended = written_table(ended.filter(F.col("end").isNotNull()), "gaps")
    open_gap = ended.withColumn("target", F.col("t") + max_seconds).filter(F.col("end.t") - F.col("t") > max_seconds)
    # Candidates of one gap at one time: the higher score wins, then the earlier frame.
    winner = F.min(F.struct(-F.col("score"), F.col("idx")))
    rest = (
        ended.filter(~F.col("is_start"))
        .groupBy(*keys, "gap_end", F.col("t").alias("ct"))
        .agg(winner.alias("w"))
        .select(*keys, "gap_end", "ct", F.col("w.idx").alias("cidx"), (-F.col("w.col1")).alias("cscore"))
    )
    near = neighbours(open_gap, rest, [*keys, "gap_end"], "target", "ct")
    usable = lambda c: F.when((F.col(f"{c}.cidx") > F.col("idx")) & (F.col(f"{c}.cidx") < F.col("end.idx")), F.col(c))
    near = near.withColumn("back", usable("back")).withColumn("ahead", usable("ahead"))
    rank = lambda c: F.when(
        F.col(c).isNotNull(),
        F.struct(F.abs(F.col(f"{c}.ct") - F.col("target")), -F.col(f"{c}.cscore"), F.col(f"{c}.cidx").alias("pick")),
    )
    chosen = near.select(*keys, "idx", F.least(rank("back"), rank("ahead"))["pick"].alias("next_idx"))
    chain = join_same(nodes.select(*keys, "idx", "is_start"), chosen, [*keys, "idx"], "left")
    kept = follow_chain(chain, keys, span).withColumnRenamed("idx", index)
    inserted = candidates.join(kept, [*keys, index], "left_semi").join(
        keyframes.select(*keys, index), [*keys, index], "left_anti"
    )
    return keyframes.unionByName(inserted.select(*keyframes.columns))


def limit_top_k(
    df: DataFrame, keys: Sequence[str], k: int, *, score: str = "score", index: str = "frame_index"
) -> DataFrame:
    """Best ``k`` rows per video; Spark trims each input partition to ``k`` before the shuffle."""
    best = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(index))
    return df.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")


def min_interval_select(
    df: DataFrame, keys: Sequence[str], m: int = MIN_INTERVAL, *, index: str = "frame_index", span: int = BLOCK_ROWS
) -> DataFrame:
    """Greedy spacing: keep the first row, then each next row at least ``m`` frames on."""
    rows = written_table(df.select(*keys, F.col(index).alias("idx")), "spacing")
    wanted = rows.withColumn("reach", F.col("idx") + m)
    links = neighbours(wanted, rows.select(*keys, F.col("idx").alias("to")), keys, "reach", "to", dense=True, span=span)
    exact = F.when(F.col("back.to") == F.col("reach"), F.col("back.to"))
    links = links.select(*keys, "idx", F.coalesce(exact, F.col("ahead.to")).alias("next_idx"))
    first = along(rows, keys, ["idx"], {"_prev": previous("idx")}, span=span)
    chain = links.join(first.select(*keys, "idx", F.col("_prev").isNull().alias("is_start")), [*keys, "idx"])
    kept = follow_chain(chain, keys, span).withColumnRenamed("idx", index)
    return df.join(kept, [*keys, index], "left_semi")


def keyframe_chain(
    candidates: DataFrame,
    score_pairs: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    *,
    min_interval: int = MIN_INTERVAL,
    horizon: int = MAX_INTERVAL,
    ssim_threshold: float = SSIM_THRESHOLD,
    exposure_threshold: float | None = None,
    index: str = "frame_index",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Keyframes by comparison with the last keyframe.

    From a keyframe i the next one is the first candidate j with ``j - i >= min_interval``
    that differs enough (``ssim <= ssim_threshold``) or, given ``exposure_threshold``,
    jumps in brightness; estimation failures never qualify. That depends on i
    alone, so pairs are scored in parallel and the choice is a chain of pointers.
    ``score_pairs`` adds ``ssim`` (and optionally ``failed``) to pairs of ``ref_index``
    and ``index``. Pairs reach ``horizon`` frames; keyframes whose successor lies
    beyond it get further bands of pairs until every chain is closed.
    """
    keys = list(keys)
    cols = [*keys, index] + (["brightness"] if exposure_threshold is not None else [])
    rows = candidates.select(*cols)
    specs = {"_prev": previous(F.struct(*[c for c in cols if c not in keys]))}
    rows = along(rows, keys, [index], specs, span=span)
    last = rows.groupBy(*keys).agg(F.max(index).alias("_end"))
    rows = written_table(rows, "chain-rows")
    last = written_table(last, "chain-ends")
    starts = rows.select(*keys, F.col(index).alias("idx"), F.col("_prev").isNull().alias("is_start"))

    def successors(refs: DataFrame | None, near: int, far: int) -> DataFrame:
        pairs = band_pairs(rows, keys, index, nearest=near, furthest=far, refs=refs)
        scored = score_pairs(pairs)
        accept = F.col("ssim") <= ssim_threshold
        if exposure_threshold is not None:
            ref = rows.select(*keys, F.col(index).alias("ref_index"), F.col("brightness").alias("_ref_b"))
            scored = scored.join(ref, [*keys, "ref_index"])
            before = F.when(
                F.col(f"_prev.{index}") >= F.col("ref_index") + min_interval, F.col("_prev.brightness")
            ).otherwise(F.col("_ref_b"))
            accept = accept | (F.abs(F.col("brightness") - before) > exposure_threshold)
        if "failed" in scored.columns:
            accept = accept & ~F.col("failed")
        return (
            scored.filter(accept).groupBy(*keys, F.col("ref_index").alias("idx")).agg(F.min(index).alias("next_idx"))
        )

    links = written_table(successors(None, min_interval, horizon), "chain-links")
    reach, searched = horizon, None
    while True:
        chain = starts.join(links, [*keys, "idx"], "left")
        kept = written_table(follow_chain(chain, keys, span), "chain-kept")
        dangling = kept.join(links, [*keys, "idx"], "left_anti").join(last, keys)
        done = F.lit(horizon)
        if searched is not None:
            dangling = dangling.join(searched, [*keys, "idx"], "left")
            done = F.coalesce(F.col("_reach"), done)
        dangling = dangling.filter(F.col("_end") - F.col("idx") > done).select(*keys, "idx")
        dangling = written_table(dangling, "chain-open")
        if dangling.isEmpty():
            break
        reach *= 2
        more = successors(dangling.withColumnRenamed("idx", index), horizon + 1, reach)
        links = written_table(links.unionByName(more), "chain-links")
        tried = dangling.withColumn("_reach", F.lit(reach))
        searched = tried if searched is None else searched.unionByName(tried).groupBy(*keys, "idx").agg(F.max("_reach").alias("_reach"))
        searched = written_table(searched, "chain-searched")
    return candidates.join(kept.withColumnRenamed("idx", index), [*keys, index], "left_semi")


def gap_suggestions(
    frames: DataFrame,
    keys: Sequence[str],
    *,
    max_interval: int = MAX_INTERVAL,
    index: str = "frame_index",
    score: str = "score",
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Wide gaps between keyframes and the best frame inside each; needs ``is_keyframe``."""
    wide = max(2, round(1.5 * max_interval))
    mark = F.when(F.col("is_keyframe"), F.col(index))
    out = along(frames, keys, [index], {"left_frame": last_known(mark), "right_frame": next_known(mark)}, span=span)
    inside = out.filter(
        ~F.col("is_keyframe") & (F.col("right_frame") - F.col("left_frame") > wide)
    )
    best = F.max_by(F.col(index), F.struct(F.col(score), -F.col(index)))
    return inside.groupBy(*keys, "left_frame", "right_frame").agg(best.alias("best_frame"))


def keyframe_order(df: DataFrame, keys: Sequence[str], *, by: str = "frame", index: str = "frame_index", score: str = "score") -> DataFrame:
    """Add ``position`` within the video, by frame or by descending score."""
    if by == "frame":
        return assign_index(df, keys, [index], "position")
    out = df.withColumn("_neg", -F.col(score))
    return assign_index(out, keys, ["_neg", index], "position").drop("_neg")


def union_distinct(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames that occur in either table."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def missing_frames(requested: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested frames without a stored row."""
    return requested.join(stored.select(*keys), list(keys), "left_anti")
