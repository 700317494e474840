"""Incremental forms of the batch operators.

State is kept per video, in a fixed number of entries that videos share by hash, so a checkpoint of an entry per video
can't be continued. Rows of a micro-batch are taken in frame order; a row at
or before the last frame seen is late: it leaves the state alone and comes out
with ``is_late`` set. State of a video without new rows is dropped after
``idle_ms`` of processing time.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelframe.operators.quality import quality_gate

IDLE_MS = 3_600_000
BUCKETS = 1024
Fold = Callable[[dict, tuple], tuple]


def stream_scores(frames: DataFrame, bounds: DataFrame, keys: Sequence[str] = ("video_id",), **options) -> DataFrame:
    """Quality of arriving frames against bounds frozen from an earlier scan."""
    return quality_gate(frames, keys, bounds=bounds, **options)


def _fold(
    frames: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: Sequence[str],
    fields: str,
    start: Callable[[], dict],
    step: Fold,
    event_time: str | None,
    idle_ms: int,
) -> DataFrame:
    """Run ``step(state, row) -> output`` over the rows of each video, in frame order.

    ``row`` is (index, *columns); the state is a small JSON object. Videos share ``BUCKETS`` state entries by hash, as an
    entry costs more than the rows of a short video; each video keeps a state and a timeout of its own in there.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    # Integers go as text, since pandas turns them into floating point where a null is among them.
    sent = {k: "string" if types[k] in ("tinyint", "smallint", "int", "bigint") else types[k] for k in keys}
    ddl = ", ".join(f"`{k}` {t}" for k, t in {**sent, index: types[index]}.items()) + f", {fields}, is_late boolean"
    names = [index, *[f.strip().split(" ")[0] for f in fields.split(", ")], "is_late"]
    width = len(names) - 2
    timeout = GroupStateTimeout.NoTimeout if event_time is None else GroupStateTimeout.EventTimeTimeout
    taken = [index, *columns] + ([event_time] if event_time and event_time not in columns else [])

    def keep(videos: dict, state: GroupState) -> None:
        """Drop the videos whose time is over and store the others."""
        if event_time is not None:
            now = state.getCurrentWatermarkMs()
            videos = {name: memory for name, memory in videos.items() if memory["until"] > now}
        if not videos:
            state.remove()
            return
        state.update((json.dumps(videos),))
        if event_time is not None:
            state.setTimeoutTimestamp(min(memory["until"] for memory in videos.values()))

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        videos = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            keep(videos, state)
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["_video", index], ignore_index=True, kind="stable")
        # Videos are many and short, so a row costs plain Python values only.
        out, name, memory = [], None, {}
        for video, *row in zip(rows["_video"].tolist(), *[rows[c].tolist() for c in (index, *columns)], strict=True):
            if video != name:
                name, memory = video, videos.setdefault(video, None) or {"last": None, **start()}
                videos[video] = memory
            if memory["last"] is not None and row[0] <= memory["last"]:
                out.append((*[None] * width, True))
                continue
            out.append((*step(memory, tuple(row)), False))
            memory["last"] = int(row[0])
        if event_time is not None:
            now = state.getCurrentWatermarkMs()
            for video, latest in rows.groupby("_video")[event_time].max().items():
                videos[video]["until"] = max(int(latest.timestamp() * 1000), now) + idle_ms
        keep(videos, state)
        made = dict(zip(names, [rows[index], *map(list, zip(*out, strict=True))], strict=True))
        yield pd.DataFrame({k: rows[k] for k in keys} | made)

    done = (
        frames.select(
            *[F.col(k).cast(t).alias(k) for k, t in sent.items()],
            *taken,
            F.to_json(F.struct(*keys)).alias("_video"),
            F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket"),
        )
        .groupBy("_bucket")
        .applyInPandasWithState(advance, ddl, "memory string", "append", timeout)
    )
    return done.select(*[F.col(k).cast(types[k]).alias(k) for k in keys], *names)


def stream_events(
    frames: DataFrame,
    keys: Sequence[str] = ("video_id",),
    index: str = "frame_index",
    *,
    jump: float = 0.3,
    window: int = 10,
    threshold: float = 15.0,
    event_time: str | None = None,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Brightness jumps and rescue mode as frames arrive (``brightness``, ``match_count``)."""

    def step(memory: dict, row: tuple) -> tuple:
        _, brightness, matches = row
        before = memory["brightness"]
        memory["brightness"] = float(brightness)
        recent = (memory["recent"] + [0.0 if pd.isna(matches) else float(matches)])[-window:]
        memory["recent"] = recent
        changed = before is not None and abs(brightness - before) > jump
        return bool(changed), bool(len(recent) >= window and sum(recent) / window < threshold)

    return _fold(
        frames,
        keys,
        index,
        ["brightness", "match_count"],
        "exposure_changed boolean, is_rescue_mode boolean",
        lambda: {"brightness": None, "recent": []},
        step,
        event_time,
        idle_ms,
    )


Vector = Sequence[float]


def _compose(a: Vector, b: Vector) -> list[float]:
    w1, x1, y1, z1 = a
    w2, x2, y2, z2 = b
    return [
        w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
        w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
        w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
        w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
    ]


def _cross(a: Vector, b: Vector) -> list[float]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _floats(v) -> list[float]:
    return np.asarray(v, float).tolist()


def stream_trajectory(
    frames: DataFrame,
    keys: Sequence[str] = ("video_id",),
    index: str = "frame_index",
    *,
    t_sign: float = 1.0,
    event_time: str | None = None,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Positions relative to the first frame as relative steps arrive.

    Columns ``vo_valid``, ``q_rel``, ``t_dir``, ``step_proxy`` and ``step_median`` (frozen).
    """

    def step(memory: dict, row: tuple) -> tuple:
        _, valid, q, t, size, median = row
        turn, place = memory["turn"], memory["place"]
        if valid:
            q, t = _floats(q), _floats(t)
            n, length = math.hypot(*q), math.hypot(*t)
            if n > 1e-12:
                turn = _compose(turn, [v / n for v in q])
                n = math.hypot(*turn)
                turn = [v / n for v in turn]
            if length > 1e-12:
                far = t_sign * max(0.0, size) / median / length
                d = [far * v for v in t]
                axis = [2.0 * v for v in _cross(turn[1:], d)]
                off = _cross(turn[1:], axis)
                place = [p + v + turn[0] * a + o for p, v, a, o in zip(place, d, axis, off, strict=True)]
        memory["turn"], memory["place"] = turn, place
        if memory["origin"] is None:
            memory["origin"] = place
        return tuple(p - o for p, o in zip(place, memory["origin"], strict=True))

    return _fold(
        frames,
        keys,
        index,
        ["vo_valid", "q_rel", "t_dir", "step_proxy", "step_median"],
        "x double, y double, z double",
        lambda: {"turn": [1.0, 0.0, 0.0, 0.0], "place": [0.0, 0.0, 0.0], "origin": None},
        step,
        event_time,
        idle_ms,
    )


def stream_chain(
    frames: DataFrame,
    keys: Sequence[str] = ("video_id",),
    index: str = "frame_index",
    *,
    features: str = "features",
    similarity: Callable[[np.ndarray, np.ndarray], float] | None = None,
    min_interval: int = 5,
    ssim_threshold: float = 0.85,
    exposure_threshold: float | None = None,
    rescue_window: int = 0,
    rescue_threshold: float = 15.0,
    event_time: str | None = None,
    idle_ms: int = IDLE_MS,
) -> DataFrame:
    """Keyframes online: spacing, then change against the last keyframe.

    Without ``similarity`` only the spacing counts. ``features`` (array<double>) is what
    ``similarity`` compares. With ``rescue_window`` the column ``match_count`` (null on a failed
    estimation) feeds the rescue rule: a failed pair is forced in while the mean
    of the last counts is low, and otherwise skipped.
    """
    columns = [c for c in (features, "brightness", "match_count") if c in frames.columns]

    def step(memory: dict, row: tuple) -> tuple:
        values = dict(zip(columns, row[1:], strict=True))
        at, key = int(row[0]), memory["key"]
        if key is not None and at - key < min_interval:
            return False, bool(memory["rescue"])
        jumped = False
        if exposure_threshold is not None:
            b = float(values["brightness"])
            jumped = memory["brightness"] is not None and abs(b - memory["brightness"]) > exposure_threshold
            memory["brightness"] = b
        if key is not None and similarity is not None:
            forced = False
            if rescue_window > 0:
                failed = pd.isna(values["match_count"])
                memory["recent"] = (memory["recent"] + [0.0 if failed else float(values["match_count"])])[-rescue_window:]
                full = len(memory["recent"]) >= rescue_window
                memory["rescue"] = full and sum(memory["recent"]) / rescue_window < rescue_threshold
                if failed and not memory["rescue"]:
                    return False, bool(memory["rescue"])
                forced = failed
            score = similarity(np.array(memory["features"]), np.asarray(values[features], float))
            if score > ssim_threshold and not forced and not jumped:
                return False, bool(memory["rescue"])
        memory["key"] = at
        if similarity is not None:
            memory["features"] = [float(v) for v in values[features]]
        return True, bool(memory["rescue"])

    return _fold(
        frames,
        keys,
        index,
        columns,
        "is_keyframe boolean, is_rescue_mode boolean",
        lambda: {"key": None, "features": None, "brightness": None, "recent": [], "rescue": False},
        step,
        event_time,
        idle_ms,
    )


def run_available(out: DataFrame, path: str, *, on_batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process everything that has arrived into a Parquet table below ``path`` and read it.

    ``on_batch`` sees every micro-batch of records as well (per-record callback hook).
    """
    writer = out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
    if on_batch is None:
        query = writer.format("parquet").start(f"{path}/rows")
    else:

        def both(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            on_batch(batch, number)

        query = writer.foreachBatch(both).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


def late_rows(out: DataFrame) -> DataFrame:
    """The side output: rows that came after a later frame of their video."""
    return out.filter(F.col("is_late"))
