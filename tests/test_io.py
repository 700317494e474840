"""Sources and sinks on small files, and streams with late rows."""

import datetime
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.sources import calibration, frames, logs, sinks, stages
from reelframe.streaming import jobs

STORAGE = """<?xml version="1.0"?>
<opencv_storage>
<image_Width>640</image_Width>
<image_Height>480</image_Height>
<Camera_Matrix type_id="opencv-matrix"><rows>3</rows><cols>3</cols><dt>d</dt><data>
    5.0e+02 0. 3.2e+02 0.
    5.1e+02 2.4e+02 0. 0. 1.</data></Camera_Matrix>
<Distortion_Coefficients type_id="opencv-matrix"><rows>{n}</rows><cols>1</cols><dt>d</dt><data>
    {terms}</data></Distortion_Coefficients>
</opencv_storage>
"""
PHOTO = """<?xml version="1.0" encoding="UTF-8"?>
<calibration>
  <projection>{projection}</projection>
  <width>100</width>
  <height>80</height>
  <f>50</f>
  <cx>-1</cx>
  <b1>2</b1>
  <k1>0.1</k1>
  <k3>0.3</k3>
  <p1>0.01</p1>
</calibration>
"""


def test_calibration_layouts(spark, tmp_path):
    (tmp_path / "a.xml").write_text(STORAGE.format(n=4, terms="0.1 0.2 0.3 0.4"))
    (tmp_path / "b.xml").write_text(STORAGE.format(n=5, terms="0.1 0.2 0.3 0.4 0.5"))
    (tmp_path / "c.xml").write_text(PHOTO.format(projection="equisolid_fisheye"))
    (tmp_path / "d.xml").write_text(PHOTO.format(projection="frame"))
    rows = {r.xml_path.rsplit("/", 1)[1]: r for r in calibration.calibration_scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.xml", "b.xml", "c.xml", "d.xml"}
    assert rows["a.xml"].model == "fisheye" and rows["b.xml"].model == "opencv"
    assert rows["a.xml"].camera_matrix == [500, 0, 320, 0, 510, 240, 0, 0, 1]
    assert rows["c.xml"].camera_matrix == [52, 0, 49, 0, 50, 40, 0, 0, 1]
    assert rows["c.xml"].dist == [0.1, 0, 0.3, 0] and rows["d.xml"].dist == [0.1, 0, 0.01, 0, 0.3]


def bitmap(gray):
    h, w = gray.shape
    body = b"".join((np.repeat(gray[y][:, None], 3, axis=1).tobytes()).ljust((3 * w + 3) // 4 * 4, b"\0") for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_frame_scan_reads_index_and_pixels(spark, tmp_path):
    (tmp_path / "clip").mkdir()
    img = np.arange(48, dtype=np.uint8).reshape(6, 8)
    (tmp_path / "clip" / "frame_000012.bmp").write_bytes(bitmap(img))
    (tmp_path / "clip" / "broken_000013.bmp").write_bytes(b"BM no image")
    row = frames.frame_scan(spark, str(tmp_path / "clip")).first()
    assert (row.video_id, row.frame_index, row.height, row.width, row.channels) == ("clip", 12, 6, 8, 3)
    assert (np.frombuffer(row.data, np.uint8).reshape(6, 8, 3)[..., 0] == img).all()


def test_dump_lines_keep_their_order(spark, tmp_path):
    text = ["junk"]
    for i in range(50):
        text += [f"[Protobuf]  TimeStamp : {i * 0.5}"] + [f"[Protobuf]   Accelerometer{a} : {i + j}" for j, a in enumerate("XYZ")]
    text.insert(10, "[Protobuf]  TimeStamp : nonsense")
    (tmp_path / "dump.txt").write_text("\n".join(text))
    lines = logs.text_lines(spark, str(tmp_path / "dump.txt"))
    a = sorted((r.sample, r.TimeStamp0, r.AccelerometerZ, r.AngularVelocityX) for r in logs.imu_scan_by_position(lines).collect())
    b = sorted((r.sample, r.TimeStamp0, r.AccelerometerZ, r.AngularVelocityX) for r in logs.imu_scan_by_block(lines).collect())
    assert a == b == [(i, i * 0.5, float(i + 2), None) for i in range(50)]


@pytest.mark.parametrize("shape", ["list", "frames", "records", "csv"])
def test_metrics_documents(spark, tmp_path, shape):
    records = [{"frame_index": 4, "tx": 1.5, "m_blur": "0.25", "flow_mag": "3"}, {"is_keyframe": "yes", "metrics": {"flow_mag": 2, "odd": "x"}}]
    if shape == "csv":
        path = tmp_path / "m.csv"
        path.write_text("frame_index,tx,m_blur,flow_mag,is_keyframe\n4,1.5,0.25,3,\n,,,,yes\n")
    else:
        path = tmp_path / "m.json"
        path.write_text(json.dumps(records if shape == "list" else {shape: records}))
    out = {r.frame_idx: r for r in logs.frame_metrics_scan(logs.frame_metrics_records(spark, str(path))).collect()}
    assert set(out) == {4, 1}
    assert out[4].t_xyz == [1.5, 0, 0] and out[4].metrics == {"blur": 0.25, "flow_mag": 3.0, "keyframe_flag": 0.0}
    assert out[1].is_keyframe and out[1].t_xyz == [1.0, 0, 0] and out[1].q_wxyz == [1, 0, 0, 0]
    if shape != "csv":
        assert out[1].metrics == {"flow_mag": 2.0, "odd": 0.0, "keyframe_flag": 1.0}


def test_stage_round_trip_and_manifest(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "frame_index")
    stages.stage_write(df, str(tmp_path), "a/b", "1")
    assert stages.stage_exists(spark, str(tmp_path), "a/b", "1") and not stages.stage_exists(spark, str(tmp_path), "a/b", "2")
    assert stages.stage_read(spark, str(tmp_path), "a/b", "1").count() == 5
    with pytest.raises(ValueError):
        stages.safe_run_id(" ")
    log = spark.createDataFrame([("r", 1, "done", "1", 5, None), ("r", 2, "failed", "0", 0, "boom"), ("r", 3, "resumed", "0", 0, None)], "run_id string, seq long, event string, stage string, rows long, error string")
    row = stages.run_manifest(log).first()
    assert row.completed_stages == ["1"] and row.failed and row.failed_stage == "0" and row.resume_count == 1
    assert stages.stage_counts(log).first().rows == 5


def test_metadata_document_parses(spark, tmp_path):
    kf = spark.createDataFrame([(1, i, i / 30.0, 0.123456, {"q": 0.98765}) for i in (3, 1, 2)], "video_id long, frame_index long, timestamp double, combined_score double, quality_scores map<string,double>")
    head = spark.createDataFrame([(1, '{"fps":30.0}'), (2, "{}")], "video_id long, header string")
    lines = sinks.keyframe_metadata_lines(head, kf)
    sinks.write_ordered(lines.filter("video_id = 1"), str(tmp_path / "doc"), ["video_id", "line_no"], format="text")
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert doc["fps"] == 30.0 and doc["keyframe_count"] == 3
    assert [k["frame_index"] for k in doc["keyframes"]] == [1, 2, 3]
    assert doc["keyframes"][0] == {"frame_index": 1, "timestamp": 0.033, "combined_score": 0.1235, "quality_scores": {"q": 0.9876}}
    empty = "".join(r.text for r in lines.filter("video_id = 2").orderBy("line_no").collect())
    assert json.loads(empty) == {"keyframe_count": 0, "keyframes": []}


def test_late_rows_leave_the_state_alone(spark, tmp_path):
    schema = "video_id long, frame_index long, brightness double, match_count double, at timestamp"
    rows = [(1, i, 0.1 if i < 4 else 0.9, 5.0) for i in range(6)]
    clock = lambda r: (*r, datetime.datetime(2024, 1, 1, 0, 0, r[1]))
    for part in (rows[:3], rows[3:], [rows[1]]):
        spark.createDataFrame([clock(r) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    for name, options in (("plain", {}), ("timed", {"event_time": "at"})):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        if options:
            stream = stream.withWatermark("at", "1 hour")
        out = jobs.stream_events(stream, window=3, threshold=10.0, **options)
        hook = (lambda batch, n: seen.append(batch.count())) if options else None
        rows_out = jobs.run_available(out, str(tmp_path / name), on_batch=hook)
        late = [(r.frame_index, r.exposure_changed) for r in jobs.late_rows(rows_out).collect()]
        assert late == [(1, None)]
        fresh = sorted((r.frame_index, r.exposure_changed, r.is_rescue_mode) for r in rows_out.filter("NOT is_late").collect())
        assert fresh == [(i, i == 4, i >= 2) for i in range(6)]
    assert sum(seen) == 7


def test_stream_scores_are_those_of_the_batch(spark, tmp_path):
    """Videos with a null key, without bounds and without measures, over two arrivals."""
    from reelframe.operators.quality import percentile_bounds, quality_gate

    fields = ["laplacian_var", "tenengrad", "exposure", "orb_keypoints"]
    schema = "video_id long, frame_index long, " + ", ".join(f"{f} double" for f in fields)
    rows = [(v, i, *[None if v == 4 else float((i * k + (v or 5)) % 90) for k in (7, 11, 13, 17)]) for v in (None, 1, 2, 3, 4) for i in range(20)]
    whole = spark.createDataFrame(rows, schema)
    bounds = percentile_bounds(whole, ["video_id"]).where("video_id IS NULL OR video_id <> 3")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.run_available(jobs.stream_scores(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), bounds), str(tmp_path / "out"))
    show = lambda df: sorted((str(r.video_id), r.frame_index, r.quality, r.drop_reason, r.is_pass) for r in df.collect())
    got = show(out)
    assert len(got) == 100 and got == show(quality_gate(whole, bounds=bounds))


def test_stream_chain_rescue_forces_failed_pairs(spark, tmp_path):
    schema = "video_id long, frame_index long, features array<double>, match_count double"
    data = [(1, i, [0.0], None) for i in range(8)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    same = lambda a, b: 1.0
    run = lambda name, **o: [
        r.frame_index
        for r in jobs.run_available(jobs.stream_chain(stream(), similarity=same, min_interval=2, **o), str(tmp_path / name)).filter("is_keyframe").orderBy("frame_index").collect()
    ]
    assert run("off") == [0]
    assert run("on", rescue_window=3) == [0, 4, 6]


def test_timestamps_fall_back_to_thirty(spark):
    df = spark.createDataFrame([(1, 30), (2, 30)], "video_id long, frame_index long")
    videos = spark.createDataFrame([(1, 15.0), (2, None)], "video_id long, fps double")
    out = {r.video_id: r.timestamp_s for r in frames.timestamps(df, videos, ["video_id"]).collect()}
    assert out == {1: 2.0, 2: 1.0}


def test_slice_of_frames(spark):
    df = spark.range(20).withColumnRenamed("id", "frame_index")
    out = frames.sample_frames(df, start=2, end=15, step=4)
    assert sorted(r.frame_index for r in out.collect()) == [2, 6, 10, 14]


def test_top_k_is_trimmed_before_the_shuffle(spark):
    from reelframe.operators.selection import limit_top_k

    df = spark.range(100).select((F.col("id") % 3).alias("video_id"), F.col("id").alias("frame_index"), F.rand(1).alias("score"))
    out = limit_top_k(df, ["video_id"], 2)
    assert out.count() == 6
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_streamed_videos_share_state_entries(spark, tmp_path, monkeypatch):
    from reelframe.streaming import jobs

    monkeypatch.setattr(jobs, "BUCKETS", 3)
    videos = [None, 2**60 + 1, 2**60 + 3, *range(20)]
    frames = [(v, i, 0.1 * ((i * 7 + (v or 5)) % 10), float((i + (v or 1)) % 20)) for v in videos for i in range(12)]
    schema = "video_id long, frame_index long, brightness double, match_count double"
    entries, found = [], []
    for part in (frames[::2], frames[1::2]):  # the odd frames of a video come late but for the last
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), window=3, threshold=10.0)
        query = out.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "rows"))
        query.awaitTermination()
        entries += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    found = {(r.video_id, r.frame_index): r for r in spark.read.schema(out.schema).parquet(str(tmp_path / "rows")).collect()}
    assert max(entries) <= 3 and len(found) == len(frames)
    for v in videos:
        known = {i: (b, m) for w, i, b, m in frames if w == v}
        taken = [0, 2, 4, 6, 8, 10, 11]
        for n, i in enumerate(taken):
            jump = n > 0 and abs(known[i][0] - known[taken[n - 1]][0]) > 0.3
            rescue = n >= 2 and sum(known[j][1] for j in taken[n - 2 : n + 1]) / 3 < 10.0
            got = found[v, i]
            assert (got.exposure_changed, got.is_rescue_mode, got.is_late) == (jump, rescue, False)
        assert all(found[v, i].is_late for i in (1, 3, 5, 7, 9))
