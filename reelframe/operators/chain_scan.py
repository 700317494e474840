"""Keyframes by comparison with the last keyframe, scoring only pairs that a scan meets (K5, with the rescue rule).

Which frame follows a keyframe depends on the state a scan arrives with: the last keyframe, the brightness of the last
tested frame and, with the rescue rule, the last match counts. So a block of frames is a map from entry state to
exit state and keyframes. A task holds a stretch of consecutive blocks and carries exits on as entries of the next one.
Stretches are scanned in parallel from the starts that spacing allows; scans that reach the same state share what
follows. Exits of a stretch become entries of the next stretch, round by round, until no block meets an entry that it
doesn't know; most scans fall in with a known one after a few keyframes. The true scan is then the chain of
entries from the first block of each video. Frames are compared inside the task that holds their block.

Rounds end when states repeat, which spacing starts bring about in two or three rounds. A sequence whose scans never
meet again takes at most one round a stretch, and stays exact.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelframe.plans.blocks import BLOCK_ROWS, TASK_ROWS, index_block
from reelframe.plans.chains import follow_chain
from reelframe.session import written_table

LOOKAHEAD = 4
#: Entries of one block that a chain of pointers can tell apart.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class ChainRules:
    """Spacing in frames, similarity above which a frame is skipped, brightness jump, and the rescue rule."""

    min_interval: int = 5
    ssim_threshold: float = 0.85
    exposure_threshold: float | None = None
    rescue_window: int = 0
    rescue_threshold: float = 15.0


Scorer = Callable[[Mapping[str, object], Mapping[str, np.ndarray]], Mapping[str, Sequence]]


@dataclass
class _State:
    """What a scan knows between two frames."""

    idx: int | None = None
    values: dict | None = None
    brightness: float | None = None
    history: tuple[float, ...] = ()
    rescue: bool = False

    def name(self) -> str:
        return f"{self.idx}|{self.brightness!r}|{self.history!r}|{self.rescue}"


@dataclass
class _Path:
    """Keyframes of a scan of one block and the state it leaves with."""

    idx: list[int]
    ref: list[int]
    ssim: list[float]
    rescue: list[bool]
    forced: list[bool]
    state: list[str]
    exit: _State
    scored: int = 0

    FIELDS = ("idx", "ref", "ssim", "rescue", "forced", "state")


class _Block:
    """Frames of one block in order, and the scans made over it so far."""

    def __init__(self, idx: np.ndarray, columns: dict[str, np.ndarray], bright: np.ndarray | None, rules: ChainRules, score: Scorer, lookahead: int):
        self.rules, self.score, self.lookahead = rules, score, lookahead
        self.idx, self.columns, self.bright = idx, columns, bright
        self.seen: dict[str, tuple[_Path, int]] = {}

    def learn(self, path: _Path) -> None:
        for k, state in enumerate(path.state):
            self.seen.setdefault(state, (path, k))

    def starts(self) -> list[int]:
        """Frames that a scan can take first, if the last keyframe lies before the block and frames differ."""
        return list(range(int(np.searchsorted(self.idx, self.idx[0] + self.rules.min_interval))))

    def _compared(self, at: _State, a: int, z: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        rows = {"idx": self.idx[a:z]} | {c: v[a:z] for c, v in self.columns.items()}
        found = self.score({"idx": at.idx, **at.values}, rows)
        more = lambda name: np.asarray(found[name]) if name in found else None
        return np.asarray(found["ssim"], float), more("match_count"), more("status")

    def scan(self, entry: _State, first: int | None = None) -> _Path:
        """Scan from ``entry``, or take frame ``first`` unseen, until the end or a state that a scan has been in."""
        rules = self.rules
        at = _State(entry.idx, entry.values, entry.brightness, entry.history, entry.rescue)
        path = _Path([], [], [], [], [], [], at)
        pos = first if first is not None else 0 if at.idx is None else int(np.searchsorted(self.idx, at.idx + rules.min_interval))
        batch = self.lookahead
        while pos < len(self.idx):
            if at.idx is None:
                window = pos + 1
                ssim = matches = status = None
            else:
                window = min(len(self.idx), pos + batch)
                ssim, matches, status = self._compared(at, pos, window)
                path.scored += window - pos
                batch = min(batch * 2, 16 * self.lookahead)
            picked = None
            for k in range(pos, window):
                jumped = False
                if self.bright is not None:
                    jumped = at.brightness is not None and abs(self.bright[k] - at.brightness) > rules.exposure_threshold
                    at.brightness = float(self.bright[k])
                if ssim is None:
                    picked, value, forced = k, None, jumped
                    break
                j = k - pos
                forced = False
                outcome = status[j] if status is not None else "ok"
                if rules.rescue_window and outcome != "degenerate":
                    count = 0.0 if outcome == "failed" else float(matches[j])
                    at.history = (at.history + (count,))[-rules.rescue_window :]
                    at.rescue = len(at.history) == rules.rescue_window and sum(at.history) / rules.rescue_window < rules.rescue_threshold
                if outcome == "failed":
                    if not at.rescue:
                        continue
                    forced = True
                if ssim[j] > rules.ssim_threshold and not forced and not jumped:
                    continue
                picked, value, forced = k, float(ssim[j]), forced or jumped
                break
            if picked is None:
                pos = window
                continue
            path.idx.append(int(self.idx[picked]))
            path.ref.append(at.idx)
            path.ssim.append(value)
            path.rescue.append(at.rescue)
            path.forced.append(forced)
            at.idx, at.values = int(self.idx[picked]), {c: v[picked] for c, v in self.columns.items()}
            name = at.name()
            path.state.append(name)
            if name in self.seen:
                known, k = self.seen[name]
                for f in _Path.FIELDS:
                    getattr(path, f).extend(getattr(known, f)[k + 1 :])
                path.exit = known.exit
                return path
            pos = int(np.searchsorted(self.idx, at.idx + rules.min_interval))
            batch = self.lookahead
        return path


def _state_of(row, prefix: str, columns: Sequence[str]) -> _State:
    idx = getattr(row, f"{prefix}idx")
    if pd.isna(idx):
        return _State()
    bright = getattr(row, f"{prefix}brightness")
    return _State(
        int(idx),
        {c: getattr(row, f"{prefix}v_{c}") for c in columns},
        None if pd.isna(bright) else float(bright),
        tuple(float(x) for x in getattr(row, f"{prefix}history")),
        bool(getattr(row, f"{prefix}rescue")),
    )


def _known_path(row, columns: Sequence[str]) -> _Path:
    lists = [list(getattr(row, f"p_{f}")) for f in _Path.FIELDS]
    return _Path(*lists, _state_of(row, "x_", columns))


def _blocks(frames: pd.DataFrame):
    """Blocks of the frames of a task in order: video, number, and a function that cuts its arrays out."""
    idx, number = frames["idx"].to_numpy(np.int64), frames["block"].to_numpy(np.int64)
    code, videos = pd.factorize(frames["scan_key"])
    order = np.lexsort((idx, code))
    idx, number, code = idx[order], number[order], code[order]
    arrays = {c: frames[c].to_numpy()[order] for c in frames.columns}
    edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(code) != 0)) + 1
    for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(idx)]):
        if z > a:

            def cut(columns, bright, a=a, z=z):
                return idx[a:z], {c: arrays[c][a:z] for c in columns}, arrays["brightness"][a:z].astype(float) if bright else None

            yield videos[code[a]], int(number[a]), cut


def keyframe_scan(
    candidates: DataFrame,
    score: Scorer,
    keys: Sequence[str],
    *,
    columns: Sequence[str],
    rules: ChainRules = ChainRules(),
    index: str = "frame_index",
    span: int = BLOCK_ROWS,
    lookahead: int = LOOKAHEAD,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Keyframes with the frame each was compared with: keys, ``index``, ``ref_index``, ``ssim``, ``is_rescue_mode``, ``is_forced``.

    ``score(ref, rows)`` compares the keyframe ``ref`` (``idx`` and ``columns`` of it) with some later frames
    (``rows``, an array for each of these) and returns ``ssim`` and, for the rescue rule, ``match_count`` and ``status``: "ok",
    "failed" (counts as no match; taken only in rescue mode) or "degenerate" (not counted, judged by ssim). It is called
    for ``lookahead`` frames and doubles that while none is taken. The first frame of a video is a keyframe without
    comparison (``ref_index`` and ``ssim`` null). ``index`` is an integer, unique per video; a block is ``span``
    indices, so choose it by the size of ``columns``; a task takes stretches of up to a quarter of ``task_rows`` indices.
    ``brightness`` is needed with ``exposure_threshold``.
    """
    keys, columns = list(keys), list(columns)
    bright = rules.exposure_threshold is not None
    extra = ["brightness"] if bright and "brightness" not in columns else []
    rows = candidates.select(*keys, F.col(index).cast("bigint").alias("idx"), *columns, *extra).withColumn("block", index_block("idx", span))
    # A name stands for the keys inside tasks, whatever their types and nulls.
    rows = written_table(rows.withColumn("scan_key", F.to_json(F.struct(*keys))), "scan-rows")
    share = max(1, task_rows // 4)
    stretch = index_block("block", max(1, share // span))
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))

    def task(df: DataFrame):
        # The number of partitions is given, as the size of the rows says little about the work on them.
        placed = df.withColumn("_task", F.pmod(F.xxhash64("scan_key", stretch), F.lit(tasks)))
        return placed.repartition(tasks, "_task").groupBy("_task")

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    state = lambda p: f"{p}idx bigint, {p}brightness double, {p}history array<double>, {p}rescue boolean" + "".join(f", `{p}v_{c}` {types[c]}" for c in columns)
    path_ddl = "p_idx array<bigint>, p_ref array<bigint>, p_ssim array<double>, p_rescue array<boolean>, p_forced array<boolean>, p_state array<string>"
    ddl = f"scan_key string, block bigint, entry string, leaves string, scored bigint, {state('x_')}, {path_ddl}"
    state_names = ["idx", "brightness", "history", "rescue", *[f"v_{c}" for c in columns]]
    names = ["scan_key", "block", "entry", "leaves", "scored", *[f"x_{c}" for c in state_names], *[f"p_{f}" for f in _Path.FIELDS]]

    def work(frames: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        wanted: dict[tuple[str, int], list] = {}
        stretches: dict[str, set[int]] = {}
        per = max(1, share // span)
        for row in asked.itertuples(index=False):
            wanted.setdefault((row.scan_key, row.block), []).append(row)
            stretches.setdefault(row.scan_key, set()).add(row.block // per)
        before, carried = None, {}
        for video, number, rows_of in _blocks(frames):
            if number // per not in stretches.get(video, ()):
                continue
            if before != (video, number // per):
                before, carried = (video, number // per), {}
            scans, met = [], set()
            block = _Block(*rows_of(columns, bright), rules, score, lookahead)
            for row in wanted.get((video, number), ()):
                if not pd.isna(row.scored):
                    block.learn(_known_path(row, columns))
                    met.add(row.entry)
                elif row.entry == "starts":
                    scans += [(f"start {p}", _State(), p) for p in block.starts()]
                else:
                    scans.append((row.entry, _state_of(row, "e_", columns), None))
            scans += [(name, at, None) for name, at in carried.items()]
            carried = {}
            for name, at, first in scans:
                if name in met:
                    continue
                met.add(name)
                path = block.scan(at, first)
                block.learn(path)
                x = path.exit
                leaves = x.name()
                carried[leaves] = x
                values = [None] * len(columns) if x.values is None else [x.values[c] for c in columns]
                fields = [getattr(path, f) for f in _Path.FIELDS]
                out.append((video, number, name, leaves, path.scored, x.idx, x.brightness, list(x.history), x.rescue, *values, *fields))
        return pd.DataFrame(out, columns=names).astype({"x_idx": "Int64", "scored": "Int64"})

    by = Window.partitionBy("scan_key").orderBy("block")
    units = rows.select(*keys, "scan_key", "block").distinct().withColumn("stretch", stretch)
    units = units.withColumns({"first": F.lag("block").over(by).isNull(), "after": F.lead("block").over(by)})
    inner = F.lag("stretch").over(by) == F.col("stretch")
    units = units.withColumns({"begins": ~F.coalesce(inner, F.lit(False)), "ends": F.col("stretch") != F.lead("stretch").over(by)})
    units = written_table(units, "scan-units")
    ends = units.where("ends").select("scan_key", "block", "after")
    asked = units.where("begins").select("scan_key", "block", F.when(F.col("first"), "none").otherwise("starts").alias("entry"))
    asked_ddl = f"scan_key string, block bigint, entry string, scored bigint, {state('e_')}, {state('x_')}, {path_ddl}"
    filled = lambda df: df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(asked_ddl)])
    known: DataFrame | None = None
    while True:
        these, mine = filled(asked), rows
        if known is not None:
            again = asked.select("scan_key", stretch.alias("_at")).distinct()
            near = lambda df: df.withColumn("_at", stretch).join(again, ["scan_key", "_at"], "left_semi").drop("_at")  # noqa: E731, B023
            these, mine = these.unionByName(filled(near(known))), near(rows)
        fresh = task(mine.drop(*keys)).cogroup(task(these)).applyInPandas(work, ddl)
        fresh = written_table(fresh, "scan-paths")
        known = fresh if known is None else known.unionByName(fresh)
        onward = fresh.join(ends, ["scan_key", "block"])
        onward = onward.select("scan_key", F.col("after").alias("block"), F.col("leaves").alias("entry"), *[F.col(f"x_{c}").alias(f"e_{c}") for c in state_names])
        # Equal states of a block are one entry; any of them has the same values.
        onward = onward.withColumn("_n", F.row_number().over(Window.partitionBy("scan_key", "block", "entry").orderBy("e_idx"))).where("_n = 1").drop("_n")
        asked = written_table(onward.join(known.select("scan_key", "block", "entry"), ["scan_key", "block", "entry"], "left_anti"), "scan-entries")
        if asked.isEmpty():
            break
    # Inside the first stretch of a video the only scan is the true one.
    true = known if ends.isEmpty() else _followed(known, units)
    named = true.join(units.select("scan_key", "block", *keys), ["scan_key", "block"])
    picks = named.select(*keys, F.explode(F.arrays_zip(*[f"p_{f}" for f in _Path.FIELDS[:-1]])).alias("p"))
    return picks.select(
        *keys, F.col("p.p_idx").alias(index), F.col("p.p_ref").alias("ref_index"), F.col("p.p_ssim").alias("ssim"),
        F.col("p.p_rescue").alias("is_rescue_mode"), F.col("p.p_forced").alias("is_forced"),
    )


def _followed(known: DataFrame, units: DataFrame) -> DataFrame:
    """The scans that follow one another from the first block of each video."""
    number = F.row_number().over(Window.partitionBy("scan_key", "block").orderBy("entry")) - 1
    # Blocks are numbered from the first of each video, so that chains hold dense, rising integers.
    placed = units.select("scan_key", "block", "after", (F.row_number().over(Window.partitionBy("scan_key").orderBy("block")) - 1).alias("at"))
    nodes = known.join(placed, ["scan_key", "block"]).withColumn("node", F.col("at") * ENTRIES + number)
    nodes = written_table(nodes, "scan-nodes")
    ahead = nodes.select("scan_key", F.col("block").alias("after"), F.col("entry").alias("leaves"), F.col("node").alias("next_idx"))
    linked = nodes.select("scan_key", "entry", "leaves", "after", "node").join(ahead, ["scan_key", "after", "leaves"], "left")
    chain = linked.select("scan_key", F.col("node").alias("idx"), "next_idx", (F.col("entry") == "none").alias("is_start"))
    reached = follow_chain(chain, ["scan_key"], ENTRIES * 1024).withColumnRenamed("idx", "node")
    return nodes.join(reached, ["scan_key", "node"], "left_semi")
