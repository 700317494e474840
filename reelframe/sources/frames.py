"""Frames as rows: scan, sampling, lookup and pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.plans.blocks import attach


def frame_scan(spark: SparkSession, path: str, *, pattern: str = r"([0-9]+)\.[A-Za-z]+$") -> DataFrame:
    """Image files as frames; the index is the number at the end of the file name.

    The folder that holds a file is its video. Undecodable files are left out.
    """
    img = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    return img.select(
        F.element_at(F.split("origin", "/"), -2).alias("video_id"),
        F.regexp_extract("origin", pattern, 1).cast("bigint").alias("frame_index"),
        "data",
        "height",
        "width",
        F.col("nChannels").alias("channels"),
    )


def sample_frames(df: DataFrame, *, step: int = 1, start: int = 0, end: int | None = None, index: str = "frame_index") -> DataFrame:
    """``range(start, end, step)`` over the frame index; pushed into the scan where possible."""
    keep = (F.col(index) >= start) & ((F.col(index) - start) % max(1, step) == 0)
    if end is not None:
        keep = keep & (F.col(index) < end)
    return df.filter(keep)


def frame_at_time(times: DataFrame, frames: DataFrame, keys: Sequence[str], fps: str | Column, *, time: str = "seconds") -> DataFrame:
    """Frame of each query time: index ``int(time * fps)``."""
    fps = F.col(fps) if isinstance(fps, str) else fps
    wanted = times.withColumn("frame_index", (F.col(time) * fps).cast("bigint"))
    return wanted.join(frames, [*keys, "frame_index"])


def frames_by_index(frames: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The requested frames once each; unknown indices are skipped."""
    return frames.join(wanted.select(*keys), list(keys), "left_semi")


def paired_scan(frames: DataFrame, keys: Sequence[str], columns: Sequence[str], *, lens: str = "lens") -> DataFrame:
    """Both lenses of a frame side by side (``a_``, ``b_``); frames with one lens drop out."""
    side = lambda p: frames.filter(F.col(lens) == p).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return side("a").join(side("b"), list(keys))


def pair_consistency_report(videos: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mismatching frame rate, frame count or size between the two lenses of a video."""
    p = paired_scan(videos, keys, ["fps", "frame_count", "width", "height"])
    return p.select(
        *keys,
        (F.abs(F.col("a_fps") - F.col("b_fps")) > 1e-3).alias("fps_differs"),
        (F.col("a_frame_count") != F.col("b_frame_count")).alias("count_differs"),
        ((F.col("a_width") != F.col("b_width")) | (F.col("a_height") != F.col("b_height"))).alias("size_differs"),
        F.least("a_frame_count", "b_frame_count").alias("frame_count"),
    )


def timestamps(df: DataFrame, videos: DataFrame, keys: Sequence[str], index: str = "frame_index") -> DataFrame:
    """Seconds of each frame; a missing frame rate counts as 30."""
    out = attach(df, videos.select(*keys, F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(30.0)).alias("_fps")), keys, F.col(index))
    fps = F.greatest(F.coalesce("_fps", F.lit(30.0)), F.lit(1e-6))
    return out.withColumn("timestamp_s", F.col(index) / fps).drop("_fps")
