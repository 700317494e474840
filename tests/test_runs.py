"""Stored stages: order, reuse, changed parameters, early end and failure."""

import pytest
from pyspark.sql import functions as F

from reelframe.sources.runs import Input, RunStore, Stage, files_fingerprint, run_stages
from reelframe.sources.stages import run_manifest


def stages(calls, threshold=0, factor=2, fail=False):
    def first(t):
        calls.append("1")
        return t["frames"].where(F.col("id") >= threshold)

    def zero(t):
        calls.append("0")
        return t["frames"].select("id", (F.col("id") % 3).alias("m"))

    def second(t):
        calls.append("2")
        if fail:
            raise ValueError("boom")
        return t["1"].join(t["0"], "id").withColumn("x", F.col("m") * factor)

    return [
        Stage("1", first, ("frames",), {"threshold": threshold}, ends_if_empty=True),
        Stage("0", zero, ("frames",)),
        Stage("2", second, ("1", "0"), {"factor": factor}),
    ]


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path), "run/1")


def inputs(spark, mark="a"):
    return {"frames": Input(spark.range(10), mark)}


def test_order_and_reuse_without_jobs(spark, store):
    calls = []
    one = run_stages(store, stages(calls), inputs(spark))
    assert calls == ["1", "0", "2"] == one.computed and one.rows == {"1": 10, "0": 10, "2": 10}
    spark.sparkContext.setJobGroup("again", "reused stages")
    two = run_stages(store, stages(calls), inputs(spark))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("again"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 0 and two.computed == [] and two.reused == ["1", "0", "2"] and len(calls) == 3
    assert sorted(map(tuple, two.tables["2"].collect())) == sorted(map(tuple, one.tables["2"].collect()))


def test_changes_rerun_what_depends_on_them(spark, store):
    calls = []
    run_stages(store, stages(calls), inputs(spark))
    assert run_stages(store, stages(calls, factor=3), inputs(spark)).computed == ["2"]
    assert run_stages(store, stages(calls, threshold=5), inputs(spark)).computed == ["1", "2"]
    assert run_stages(store, stages(calls), inputs(spark)).computed == []
    assert run_stages(store, stages(calls), inputs(spark, "b")).computed == ["1", "0", "2"]
    assert run_stages(store, stages(calls), inputs(spark), resume=False).computed == ["1", "0", "2"]


def test_an_empty_first_stage_ends_the_run(spark, store):
    calls = []
    for _ in range(2):
        out = run_stages(store, stages(calls, threshold=99), inputs(spark))
        assert out.ended_by == "1" and calls == ["1"] and out.rows == {"1": 0}


def test_a_failed_run_is_taken_up(spark, store):
    calls = []
    with pytest.raises(ValueError, match="boom"):
        run_stages(store, stages(calls, fail=True), inputs(spark))
    row = run_manifest(store.events()).first()
    assert (row.failed, row.failed_stage, row.completed_stages) == (True, "2", ["0", "1"]) and "boom" in row.error
    assert run_stages(store, stages(calls), inputs(spark)).computed == ["2"]


def test_a_table_without_marker_does_not_count(spark, store, tmp_path):
    calls = []
    run_stages(store, stages(calls), inputs(spark))
    for marker in tmp_path.glob("stages/stage=0/*/_COMMITTED"):
        marker.unlink()
    assert run_stages(store, stages(calls), inputs(spark)).computed == ["0"]


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    one = files_fingerprint(spark, path)
    assert one == files_fingerprint(spark, path)
    spark.range(3).write.mode("append").parquet(path)
    assert one != files_fingerprint(spark, path)
