"""Text dumps, timing lists and recorded metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.plans.blocks import along, assign_index, attach, running_count

# Head of a dump line and the tags of an inertial sample.
DUMP_HEAD = "[Protobuf]"
STAMP = "TimeStamp"
ACCEL = ("AccelerometerX", "AccelerometerY", "AccelerometerZ")
GYRO = ("AngularVelocityX", "AngularVelocityY", "AngularVelocityZ")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their order: ``source``, ``line_no`` (from 0), ``text``.

    The order comes from the file split and the position read inside it, so a
    large file is still read in parallel.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("text"),
    )
    return assign_index(lines, ["source"], ["_start", "_id"], "line_no").drop("_start", "_id")


def _tagged(lines: DataFrame) -> DataFrame:
    # A tag and its value stand after the head, parted by the first colon between blanks.
    parts = F.split(F.substr("text", F.lit(len(DUMP_HEAD) + 1)), r"\s:\s", 2)
    tag, value = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return (
        lines.filter(F.startswith("text", F.lit(DUMP_HEAD)))
        .select("source", "line_no", tag.alias("tag"), value.alias("value"))
        .filter(F.col("tag").isin(STAMP, *ACCEL, *GYRO) & F.col("value").isNotNull())
    )


def _sample_columns(order: str) -> list[Column]:
    return [F.max_by("value", F.when(F.col("tag") == t, F.col(order))).alias(t) for t in (STAMP, *ACCEL, *GYRO)]


def _from_first(df: DataFrame, order: str) -> DataFrame:
    first = df.groupBy("source").agg(F.min_by(STAMP, order).alias("_t0"))
    out = attach(df, first, ["source"], F.col(order))
    return out.withColumn("TimeStamp0", F.col(STAMP) - F.col("_t0")).drop("_t0")


def imu_scan_by_position(lines: DataFrame) -> DataFrame:
    """The n-th time stamp with the n-th reading of each axis, while all are there.

    Gyro readings are optional. Assumes that a dump lists every axis once per set.
    """
    tagged = assign_index(_tagged(lines), ["source", "tag"], ["line_no"], "sample")
    value = lambda t: F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t)
    out = tagged.groupBy("source", "sample").agg(*[value(t) for t in (STAMP, *ACCEL, *GYRO)])
    out = out.dropna(subset=[STAMP, *ACCEL])
    whole = F.col(GYRO[0]).isNotNull() & F.col(GYRO[1]).isNotNull() & F.col(GYRO[2]).isNotNull()
    out = out.withColumns({g: F.when(whole, F.col(g)) for g in GYRO})
    return _from_first(out, "sample")


def imu_scan_by_block(lines: DataFrame) -> DataFrame:
    """The lines after each time stamp form one sample; kept if all accelerations are there."""
    tagged = along(_tagged(lines), ["source"], ["line_no"], {"_block_no": running_count(F.col("tag") == STAMP)})
    out = (
        tagged.filter(F.col("_block_no") > 0)
        .groupBy("source", "_block_no")
        .agg(F.min("line_no").alias("first_line"), *_sample_columns("line_no"))
        .dropna(subset=[STAMP, *ACCEL])
        .drop("_block_no")
    )
    out = assign_index(out, ["source"], ["first_line"], "sample").drop("first_line")
    return _from_first(out, "sample")


def frame_pts_scan(lines: DataFrame, *, columns: int = 1) -> DataFrame:
    """Frame times from lines ``t`` (numbered in order) or ``frame,t``; bad lines are skipped."""
    parts = F.split(F.trim("text"), ",")
    if columns == 1:
        good = lines.withColumn("pts_sec", F.trim(F.get(parts, F.lit(0))).try_cast("double")).filter("pts_sec IS NOT NULL")
        return assign_index(good.select("source", "line_no", "pts_sec"), ["source"], ["line_no"], "frame_idx").drop("line_no")
    return lines.select(
        "source",
        F.trim(F.get(parts, F.lit(0))).try_cast("bigint").alias("frame_idx"),
        F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("pts_sec"),
    ).dropna(subset=["frame_idx", "pts_sec"])


# Flat record fields that count as metrics.
METRIC_FIELDS = (
    "translation_delta",
    "vo_step_proxy",
    "vo_step_proxy_norm",
    "vo_inlier_ratio",
    "vo_confidence",
    "vo_feature_uniformity",
    "vo_track_sufficiency",
    "vo_pose_plausibility",
    "vo_tracked_count",
    "vo_rot_deg",
    "vo_dir_cos_prev",
    "rotation_delta",
    "flow_mag",
    "laplacian_var",
    "match_count",
    "overlap_ratio",
    "exposure_ratio",
    "keyframe_flag",
    "combined_score",
    "stationary_vo_flag",
    "stationary_flow_flag",
    "is_stationary",
    "stationary_confidence",
    "stationary_penalty_applied",
)
# Words that mean yes.
YES = ("1", "true", "yes", "y", "on")


def frame_metrics_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON documents (a list, ``{frames}`` or ``{records}``) or CSV files.

    Returns ``source``, ``position`` and ``record`` (map of raw strings).
    """
    if path.rstrip("/").lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        fields = F.map_from_arrays(F.array(*[F.lit(c) for c in rows.columns]), F.array(*[F.col(c) for c in rows.columns]))
        rows = rows.select(
            F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("_s"),
            F.monotonically_increasing_id().alias("_i"),
            F.map_filter(fields, lambda k, v: v.isNotNull()).alias("record"),
        )
        return assign_index(rows, ["source"], ["_s", "_i"], "position").drop("_s", "_i")
    docs = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    many = "array<map<string,string>>"
    whole = F.from_json("value", "frames array<map<string,string>>, records array<map<string,string>>")
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", many))
    return docs.select("source", F.posexplode(F.coalesce(listed, whole["frames"], whole["records"])).alias("position", "record"))


def frame_metrics_scan(records: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Typed frames from raw string maps, with lenient numbers and the usual defaults."""
    r = F.col("record")
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    numbers = lambda m: F.transform_values(m, lambda _, v: number(v))
    nested = F.coalesce(F.from_json(F.element_at(r, "metrics"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    flat = F.map_filter(r, lambda k, _: k.isin(*METRIC_FIELDS))
    short = F.transform_keys(F.map_filter(r, lambda k, _: k.startswith("m_")), lambda k, _: F.substring(k, 3, 10_000))
    # Later sources win: nested, then flat fields, then the m_ fields.
    without = lambda m, other: F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k))
    merged = F.map_concat(without(without(nested, flat), short), without(flat, short), short)
    index = F.coalesce(
        F.element_at(r, "frame_index").try_cast("double").cast("bigint"),
        F.element_at(r, "frame_idx").try_cast("double").cast("bigint"),
        F.col("position").cast("bigint"),
    )
    df = records.select(*keys, "position", "record", index.alias("frame_idx"), numbers(merged).alias("metrics"))
    one = lambda name, default: F.coalesce(F.element_at("record", name).try_cast("double"), default)
    vector = lambda name: F.from_json(F.element_at("record", name), "array<double>")
    t = F.coalesce(vector("t_xyz"), F.array(one("tx", F.col("frame_idx").cast("double")), one("ty", F.lit(0.0)), one("tz", F.lit(0.0))))
    q = F.coalesce(vector("q_wxyz"), F.array(one("qw", F.lit(1.0)), one("qx", F.lit(0.0)), one("qy", F.lit(0.0)), one("qz", F.lit(0.0))))
    said = F.lower(F.trim(F.element_at("record", "is_keyframe")))
    flag = F.coalesce(said.isin(*YES), F.element_at("metrics", "keyframe_flag") != 0, F.lit(False))
    df = df.select(*keys, "frame_idx", t.alias("t_xyz"), q.alias("q_wxyz"), flag.alias("is_keyframe"), "metrics")
    has = F.map_contains_key("metrics", F.lit("keyframe_flag"))
    added = F.map_concat("metrics", F.create_map(F.lit("keyframe_flag"), F.col("is_keyframe").cast("double")))
    return df.withColumn("metrics", F.when(has, F.col("metrics")).otherwise(added))
