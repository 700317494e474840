"""The given tables seen as frames, each view once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.plans.blocks import assign_index, attach

# Derived frame columns, written so that Spark and DuckDB read the same text.
EVENT_FIELDS = {
    "laplacian_var": "value",
    "tenengrad": "value * (1.0 + k / 50.0)",
    "exposure": "least(value / 100.0, 1.0)",
    "orb_keypoints": "k",
    "motion_blur": "k / 100.0",
    "flow_mag": "value / 8.0",
    "ssim": "1.0 - k / 100.0",
    "match_count": "k",
    "rotation_delta": "k / 4.0",
    "step_proxy": "value / 10.0",
    "inlier_ratio": "0.3 + k / 200.0",
    "brightness": "k / 100.0",
    "vo_attempted": "event_type <> 'signup'",
    "vo_valid": "event_type IN ('view', 'click', 'purchase')",
    "score": "least(0.2 + value / 300.0 + k / 1000.0, 1.0)",
    "yaw": "k * 3.6",
    "pitch": "value / 10.0 - 20.0",
}
_EVENT_SQL = ", ".join(f"{e} AS {c}" for c, e in EVENT_FIELDS.items())

# Rows keyed by event id: no order needed, so no shuffle either.
ROWS_SQL = f"""rows_v AS (
  SELECT user_id AS video_id, event_id AS frame_index, event_type, {_EVENT_SQL} FROM (
    SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""

# Rows numbered per video in time order.
FRAMES_SQL = f"""frames_v AS (
  SELECT user_id AS video_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS timestamp_s,
    event_type, {_EVENT_SQL} FROM (
    SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k FROM events))"""

SCAN_SQL = """scan_v AS (
  SELECT l_suppkey AS video_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
      l_partkey, l_quantity, l_extendedprice) - 1 AS frame_index,
    l_extendedprice AS laplacian_var, l_quantity AS tenengrad, 1 - l_discount AS exposure,
    l_partkey % 500 AS orb_keypoints, l_quantity AS flow_mag, 1 - l_tax AS ssim
  FROM lineitem)"""

PIXELS_SQL = """pixels_v AS (
  SELECT label AS video_id, vec_id AS frame_index, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
    least(greatest(round((CAST(embedding[i] AS DOUBLE) + 1) * 127.5), 0), 255) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) AS idx)"""

LARGE = 64
LARGE_SQL = f"""large_v AS (
  SELECT label AS video_id, vec_id AS frame_index, i // {LARGE} AS y, i % {LARGE} AS x,
    least(greatest(round((CAST(embedding[(i % {LARGE} + 5 * (i // {LARGE})) % 64 + 1] AS DOUBLE) + 1) * 127.5), 0), 255) AS v
  FROM embeddings, (SELECT unnest(range({LARGE * LARGE})) AS i) AS idx)"""

SEQUENCE_SQL = """sequence_v AS (
  SELECT label AS video_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index
  FROM embeddings)"""

VIEWS = {"rows_v": ROWS_SQL, "frames_v": FRAMES_SQL, "scan_v": SCAN_SQL, "pixels_v": PIXELS_SQL, "large_v": LARGE_SQL, "sequence_v": SEQUENCE_SQL}


def with_views(body: str, *, recursive: bool = False) -> str:
    """Prefix ``body`` (optionally starting with ``, more AS (...)``) with the views it names."""
    used = [sql for name, sql in VIEWS.items() if name in body]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(used)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_fields(df: DataFrame) -> list:
    return [F.expr(e).alias(c) for c, e in EVENT_FIELDS.items()]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("double")
    return table(spark, sf_dir, "events").withColumn("k", k)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir)
    return df.select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"), "event_type", *_event_fields(df)
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    df = df.select(F.col("user_id").alias("video_id"), "event_id", "us", "event_type", *_event_fields(df))
    df = assign_index(df, ["video_id"], ["us", "event_id"])
    start = df.groupBy("video_id").agg(F.min("us").alias("us0"))
    df = attach(df, start, ["video_id"], F.col("frame_index"))
    return df.withColumn("timestamp_s", (F.col("us") - F.col("us0")) / 1e6).drop("us", "us0", "event_id")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("video_id"),
        "l_shipdate",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("l_extendedprice").alias("laplacian_var"),
        F.col("l_quantity").alias("tenengrad"),
        (1 - F.col("l_discount")).alias("exposure"),
        (F.col("l_partkey") % 500).alias("orb_keypoints"),
        F.col("l_quantity").alias("flow_mag"),
        (1 - F.col("l_tax")).alias("ssim"),
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "tenengrad", "laplacian_var"]
    return assign_index(df, ["video_id"], order).drop(*order[:4])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grey frames, one row per pixel."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"), F.posexplode("embedding").alias("i", "e")
    )
    v = F.least(F.greatest(F.round((F.col("e").cast("double") + 1) * 127.5), F.lit(0.0)), F.lit(255.0))
    return e.select(
        "video_id", "frame_index", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.alias("v")
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as binary payloads."""
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"), F.col("vec_id").alias("frame_index"), "embedding"
    )
    level = F.transform(
        "embedding",
        lambda x: F.least(F.greatest(F.round((x.cast("double") + 1) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("int"),
    )
    digits = F.transform(level, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0"))
    return e.select(
        "video_id",
        "frame_index",
        F.unhex(F.array_join(digits, "")).alias("data"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("channels"),
    )


def large_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 64 x 64 as binary payloads: row y is the first row moved by 5 y values."""
    level = lambda x: F.least(F.greatest(F.round((x.cast("double") + 1) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("bigint")
    e = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video_id"),
        F.col("vec_id").alias("frame_index"),
        F.transform("embedding", lambda x: F.lpad(F.hex(level(x)), 2, "0")).alias("first"),
    )
    turned = lambda y: F.concat(F.slice("first", y * 5 % 64 + 1, F.lit(64)), F.slice("first", F.lit(1), y * 5 % 64))
    rows = F.transform(F.sequence(F.lit(0), F.lit(LARGE - 1)), lambda y: F.array_join(turned(y), ""))
    size = F.lit(LARGE)
    return e.select(
        "video_id", "frame_index", F.unhex(F.array_join(rows, "")).alias("data"), size.alias("height"), size.alias("width"), F.lit(1).alias("channels")
    )


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers of the grey frames within their video; no pixels travel."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), "vec_id")
    return assign_index(e, ["video_id"], ["vec_id"])
