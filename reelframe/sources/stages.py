"""Stage tables, run manifests, parameters and throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("1", "0", "2", "3")


def safe_run_id(run_id: str) -> str:
    """Run id without path separators; it must not be empty."""
    text = run_id.strip().replace("/", "_").replace("\\", "_")
    if not text:
        raise ValueError("a run id is required")
    return text


def stage_write(df: DataFrame, root: str, run_id: str, stage: str) -> str:
    """Write one stage of a run, replacing an earlier attempt."""
    path = f"{root.rstrip('/')}/run_id={safe_run_id(run_id)}/stage={stage}"
    df.write.mode("overwrite").parquet(path)
    return path


def stage_read(spark: SparkSession, root: str, run_id: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/run_id={safe_run_id(run_id)}/stage={stage}")


def stage_exists(spark: SparkSession, root: str, run_id: str, stage: str) -> bool:
    """A stage counts as written once its success marker is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/run_id={safe_run_id(run_id)}/stage={stage}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def run_manifest(log: DataFrame) -> DataFrame:
    """State of each run from its log of (run_id, seq, event, stage, rows, error).

    Events: ``done``, ``failed``, ``resumed``, ``cleaned``; the latest failure counts unless
    the run was cleaned up after it.
    """
    e = F.col("event")
    last = lambda name: F.max(F.when(e == name, F.col("seq")))
    out = log.groupBy("run_id").agg(
        F.array_sort(F.collect_set(F.when(e == "done", F.col("stage")))).alias("completed_stages"),
        F.count_if(e == "resumed").alias("resume_count"),
        last("failed").alias("_failed"),
        last("cleaned").alias("_cleaned"),
        F.max_by("stage", F.when(e == "failed", F.col("seq"))).alias("failed_stage"),
        F.max_by("error", F.when(e == "failed", F.col("seq"))).alias("error"),
    )
    failed = F.col("_failed").isNotNull() & (F.col("_failed") > F.coalesce("_cleaned", F.lit(-1)))
    status = F.when(failed, "retained_on_error").when(F.col("_cleaned").isNotNull(), "removed").otherwise("pending")
    return out.select(
        "run_id",
        "completed_stages",
        "resume_count",
        failed.alias("failed"),
        F.when(failed, F.col("failed_stage")).alias("failed_stage"),
        F.when(failed, F.col("error")).alias("error"),
        status.alias("cleanup_status"),
    )


def stage_counts(log: DataFrame) -> DataFrame:
    """Latest row count of each completed stage."""
    return log.filter(F.col("event") == "done").groupBy("run_id", "stage").agg(F.max_by("rows", "seq").alias("rows"))


def stages_to_run(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Requested (run_id, stage) without a completed stage."""
    return wanted.join(log.filter(F.col("event") == "done").select("run_id", "stage"), ["run_id", "stage"], "left_anti")


WEIGHTS = ("weight_sharpness", "weight_exposure", "weight_geometric", "weight_content")


def params_overlay(videos: DataFrame, layers: Sequence[tuple[DataFrame, Sequence[str]]], defaults: dict[str, float]) -> DataFrame:
    """Parameters per video: later layers win over earlier ones, defaults fill the rest.

    Each layer is (table, join columns), for example presets by ``preset`` and overrides
    by ``video_id``. Adds ``violations``: weights off 1, or a minimum interval not
    below the maximum.
    """
    names = list(defaults)
    out = videos
    for i, (layer, on) in enumerate(layers):
        have = [c for c in names if c in layer.columns]
        out = out.join(layer.select(*on, *[F.col(c).alias(f"_{i}_{c}") for c in have]), list(on), "left")
    pick = lambda c: F.coalesce(
        *[F.col(f"_{i}_{c}") for i in reversed(range(len(layers))) if f"_{i}_{c}" in out.columns], F.lit(defaults[c])
    )
    out = out.select(*videos.columns, *[pick(c).alias(c) for c in names])
    broken = []
    if all(w in names for w in WEIGHTS):
        total = sum((F.col(w) for w in WEIGHTS[1:]), F.col(WEIGHTS[0]))
        broken.append(F.when(~total.between(0.99, 1.01), F.lit("weight_sum")))
    if {"min_keyframe_interval", "max_keyframe_interval"} <= set(names):
        broken.append(F.when(F.col("min_keyframe_interval") >= F.col("max_keyframe_interval"), F.lit("interval_order")))
    return out.withColumn("violations", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def stage_throughput(timings: DataFrame) -> DataFrame:
    """Frames per second of each stage; 0 for no measurable time."""
    t = F.col("elapsed_seconds")
    return timings.withColumn("throughput_fps", F.when(t > 1e-9, F.col("frames") / t).otherwise(0.0))


def run_compare(current: DataFrame, previous: DataFrame, on: Sequence[str] = ("stage",)) -> DataFrame:
    """Percent change of time and throughput against an earlier run, 0 for a base near 0."""
    prev = previous.select(*on, F.col("elapsed_seconds").alias("_t"), F.col("throughput_fps").alias("_f"))
    change = lambda c, base: F.when(F.col(base) > 1e-9, (F.col(c) - F.col(base)) / F.col(base) * 100.0).otherwise(0.0)
    return (
        current.join(prev, list(on))
        .withColumn("time_change_pct", change("elapsed_seconds", "_t"))
        .withColumn("fps_change_pct", change("throughput_fps", "_f"))
        .drop("_t", "_f")
    )
