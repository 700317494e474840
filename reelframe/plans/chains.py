"""Selections in which each decision depends on the previous one.

Both helpers give the result of a sequential scan without running one. A chain
of "next" pointers is followed inside bounded blocks, and only block entries and
exits are chained across blocks. Greedy suppression decides in each block what
the block can decide, then moves the block borders and repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.plans.blocks import BLOCK_ROWS, assign_index, in_tasks, index_block, join_same
from reelframe.session import written_table

FOLD_ROWS = 1 << 20
BLOCKS_PER_LEVEL = 1 << 10


def _pointers(pdf: pd.DataFrame, unit: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows by unit and index and, per row, the position of its successor (-1 outside)."""
    unit_no = pdf.groupby(list(unit), sort=False).ngroup().to_numpy(np.int64)
    idx = pdf["idx"].to_numpy(np.int64)
    nxt = pdf["next_idx"].fillna(-1).to_numpy(np.int64)
    width = max(idx.max(initial=0), nxt.max(initial=0)) + 2
    code = unit_no * width + idx
    order = np.argsort(code, kind="stable")
    code, wanted = code[order], (unit_no * width + nxt)[order]
    pos = np.searchsorted(code, wanted)
    inside = (nxt[order] >= 0) & (pos < len(code))
    inside[inside] = code[pos[inside]] == wanted[inside]
    return pdf.iloc[order].reset_index(drop=True), np.where(inside, pos, -1)


def _exits(pdf: pd.DataFrame, unit: Sequence[str]) -> pd.DataFrame:
    """Where the chain from each start or entry leaves its unit; -1 where it ends inside."""
    pdf, succ = _pointers(pdf, unit)
    end = np.where(succ >= 0, succ, np.arange(len(succ)))
    while True:
        further = end[end]
        if (further == end).all():
            break
        end = further
    leave = pdf["next_idx"].fillna(-1).to_numpy(np.int64)[end]
    pdf["next_idx"] = leave
    return pdf[pdf["is_entry"] | (pdf["is_start"] & (leave >= 0))]


def _walk(pdf: pd.DataFrame, unit: Sequence[str]) -> pd.DataFrame:
    """All rows reached from the starts of their unit."""
    pdf, succ = _pointers(pdf, unit)
    hit = np.zeros(len(pdf), dtype=bool)
    front = np.flatnonzero(pdf["is_start"].to_numpy(bool))
    while front.size:
        hit[front] = True
        front = succ[front]
        front = np.unique(front[front >= 0])
        front = front[~hit[front]]
    return pdf[hit]


def follow_chain(nodes: DataFrame, keys: Sequence[str], span: int = BLOCK_ROWS) -> DataFrame:
    """Rows reached from any start by following ``next_idx``.

    ``nodes`` has the keys, ``idx`` (bigint, unique per key), ``next_idx`` (a later
    ``idx`` of the same key or null) and ``is_start``. Returns keys and ``idx``.
    """
    keys = list(keys)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in keys)
    nodes = nodes.select(*keys, "idx", "next_idx", "is_start").withColumn("_block", index_block("idx", span))
    nodes = written_table(nodes, "chain")
    targets = (
        nodes.filter(index_block("next_idx", span) != F.col("_block"))
        .select(*keys, F.col("next_idx").alias("idx"))
        .distinct()
        .withColumn("is_entry", F.lit(True))
    )
    flagged = nodes.join(targets, [*keys, "idx"], "left").withColumn(
        "is_entry", F.coalesce("is_entry", F.lit(False))
    )
    cols = [*keys, "idx", "next_idx", "is_start", "is_entry"]
    block = [*keys, "_block"]
    links = (
        in_tasks(written_table(flagged, "chain-flagged"), block)
        .applyInPandas(
            lambda pdf: _exits(pdf, block)[cols],
            f"{key_ddl}, idx bigint, next_idx bigint, is_start boolean, is_entry boolean",
        )
        .withColumn("next_idx", F.when(F.col("next_idx") >= 0, F.col("next_idx")))
    )
    links = written_table(links.drop("is_entry"), "links")
    widest = links.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    out_cols = [*keys, "idx"]
    if widest <= FOLD_ROWS:
        reached = (
            in_tasks(links, keys)
            .applyInPandas(lambda pdf: _walk(pdf, keys)[out_cols], f"{key_ddl}, idx bigint")
        )
    else:
        reached = follow_chain(links, keys, span * BLOCKS_PER_LEVEL)
    started = nodes.join(reached.withColumn("_hit", F.lit(True)), [*keys, "idx"], "left").withColumn(
        "is_start", F.col("is_start") | F.col("_hit").isNotNull()
    )
    return (
        in_tasks(started.drop("_hit"), block, size=nodes.count())
        .applyInPandas(lambda pdf: _walk(pdf, block)[out_cols], f"{key_ddl}, idx bigint")
    )


def _near(t: np.ndarray, code: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Range of the rows of the same unit less than ``window`` away; rows are in order of unit and time."""
    low, high = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
    edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(t)]
    for a, z in zip(edges, edges[1:]):
        low[a:z] = a + np.searchsorted(t[a:z], t[a:z] - window - 1e-9)
        high[a:z] = a + np.searchsorted(t[a:z], t[a:z] + window + 1e-9, side="right")
    for border, step in ((low, 1), (high, -1)):
        open_ = np.flatnonzero(low < high)
        while open_.size:
            row = border[open_] - (step < 0)
            open_ = open_[~(np.abs(t[row] - t[open_]) < window)]
            border[open_] += step
            open_ = open_[low[open_] < high[open_]]
    return low, high


def _suppress_blocks(pdf: pd.DataFrame, unit: Sequence[str], window: float) -> pd.DataFrame:
    """Decide in each unit every own row whose outcome does not hang on rows outside the unit.

    Rows with ``kept`` set were decided earlier; they only remove rows near them. Returns newly kept and open rows.
    """
    code = pdf.groupby(list(unit), sort=False, dropna=False).ngroup().to_numpy(np.int64)
    order = np.lexsort((pdf["idx"].to_numpy(), pdf["t"].to_numpy(float), code))
    pdf, code = pdf.iloc[order].reset_index(drop=True), code[order]
    own = (pdf["_home"] == pdf["_block"]).to_numpy(bool)
    before = pdf["kept"].to_numpy(bool)
    low, high = (e.tolist() for e in _near(pdf["t"].to_numpy(float), code, window))
    kept, gone, doubt = bytearray(before.tobytes()), bytearray(len(pdf)), bytearray(len(pdf))

    def mark(flags: bytearray, i: int) -> None:
        if high[i] > low[i]:
            flags[low[i] : high[i]] = b"\x01" * (high[i] - low[i])

    for i in np.flatnonzero(before).tolist():
        mark(gone, i)
    for i in np.flatnonzero(before).tolist():
        gone[i] = 0
    mine = own.tolist()
    for i in np.lexsort((pdf["idx"].to_numpy(), -pdf["score"].to_numpy(float))).tolist():
        if kept[i] or gone[i]:
            continue
        if mine[i] and not doubt[i]:
            mark(gone, i)
            gone[i], kept[i] = 0, 1
        else:
            mark(doubt, i)
    pdf["kept"] = np.frombuffer(bytes(kept), dtype=bool)
    return pdf[own & ~np.frombuffer(bytes(gone), dtype=bool) & ~before]


def _highest(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Row of the highest rank in each range [first, last); -1 for empty ranges."""
    n = len(rank)
    table = [np.arange(n)]
    width = 1
    while 2 * width <= n:
        low = table[-1]
        a, b = low[: n - 2 * width + 1], low[width : n - width + 1]
        table.append(np.where(rank[a] > rank[b], a, b))
        width *= 2
    out = np.full(len(first), -1)
    size = last - first
    for k, rows in enumerate(table):
        mine = (size >= 1 << k) & (size < 2 << k)
        a, b = rows[first[mine]], rows[last[mine] - (1 << k)]
        out[mine] = np.where(rank[a] > rank[b], a, b)
    return out


def _pointers_block(pdf: pd.DataFrame, window: float) -> pd.DataFrame:
    """For each own open row: whether no row near it is higher, and which row is kept if it is kept.

    To either side, the row that follows a kept one is found by a climb: from the highest row of the first window
    beyond its reach to the highest row of the next window, while that is higher. ``climb`` and ``begin`` are these steps.
    """
    pdf = pdf.sort_values(["t", "idx"], ignore_index=True)
    t, kept = pdf["t"].to_numpy(float), pdf["kept"].to_numpy(bool)
    apart = lambda a, b: np.abs(a - b) >= window
    # Rows near a kept one are gone; the kept ones themselves stay as starts.
    k = np.flatnonzero(kept)
    at = np.searchsorted(t[k], t)
    gone = np.zeros(len(t), bool)
    if len(k):
        gone = ~apart(t, t[k[np.minimum(at, len(k) - 1)]]) | ~apart(t, t[k[np.maximum(at - 1, 0)]])
    pdf = pdf[~gone | kept].reset_index(drop=True)
    t, kept, pos = pdf["t"].to_numpy(float), pdf["kept"].to_numpy(bool), pdf["pos"].to_numpy(np.int64)
    order = np.lexsort((pdf["idx"].to_numpy(), -pdf["score"].to_numpy(float)))
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))[::-1]
    rank[kept] = -1  # their neighbours are gone, so they hold nobody back
    n = np.arange(len(t))

    def moved(e: np.ndarray, wrong, step: int) -> np.ndarray:
        """Correct rounding at the border of a range, row by row."""
        while (bad := wrong(e)).any():
            e = e + step * bad
        return e

    inside = lambda e: np.clip(e, 0, len(t) - 1)
    low = np.searchsorted(t, t - window)
    low = moved(low, lambda e: (e < n) & (t - t[inside(e)] >= window), 1)
    low = moved(low, lambda e: (e > 0) & (t - t[inside(e - 1)] < window), -1)
    high = np.searchsorted(t, t + window, side="right")
    high = moved(high, lambda e: (e > n + 1) & (t[inside(e - 1)] - t >= window), -1)
    high = moved(high, lambda e: (e < len(t)) & (t[inside(e)] - t < window), 1)
    # Rows in [low, high) are near.
    left_best, right_best = _highest(rank, low, n), _highest(rank, n + 1, high)
    higher = lambda best: np.where((best >= 0) & (rank[np.maximum(best, 0)] > rank), best, -1)
    left_up, right_up = higher(left_best), higher(right_best)
    left_begin = _highest(rank, np.minimum(np.searchsorted(t, t - 2 * window), low), low)
    right_begin = _highest(rank, high, np.maximum(np.searchsorted(t, t + 2 * window, side="right"), high))
    named = lambda rows: np.where(rows >= 0, pos[np.maximum(rows, 0)], -1)
    out = pdf.assign(
        is_start=kept | ((left_up < 0) & (right_up < 0)),
        climb_left=named(left_up), begin_left=named(left_begin), climb_right=named(right_up), begin_right=named(right_begin),
    )
    return out[(pdf["_home"] == pdf["_block"]).to_numpy(bool)]


def _pointers_blocks(pdf: pd.DataFrame, unit: Sequence[str], window: float) -> pd.DataFrame:
    return pd.concat([_pointers_block(part, window) for _, part in pdf.groupby(list(unit), sort=False, dropna=False)])


def _chained(pointers: DataFrame, keys: Sequence[str], starts: DataFrame, side: str, span: int) -> DataFrame:
    """Rows that are kept because ``starts`` are, following climbs to one side. Two nodes a row: climbing at it, kept."""
    last = pointers.agg(F.max("pos")).first()[0] or 0  # to the left, positions count from the end
    flip = (lambda c: F.lit(last) - c) if side == "left" else (lambda c: c)
    node = lambda c, kind: flip(F.col(c)) * 2 + kind
    to = lambda c: F.when(F.col(c) >= 0, node(c, 0))
    rows = join_same(pointers.select(*keys, "pos", f"climb_{side}", f"begin_{side}"), starts.withColumn("_start", F.lit(True)), [*keys, "pos"], "left")
    climbing = rows.select(*keys, node("pos", 0).alias("idx"), F.coalesce(to(f"climb_{side}"), node("pos", 1)).alias("next_idx"), F.lit(False).alias("is_start"))
    kept = rows.select(*keys, node("pos", 1).alias("idx"), to(f"begin_{side}").alias("next_idx"), F.col("_start").isNotNull().alias("is_start"))
    reached = follow_chain(climbing.unionByName(kept), keys, span).where("idx % 2 = 1")
    return reached.select(*keys, flip(F.expr("(idx - 1) div 2")).alias("pos"))


def _spread(rows: DataFrame, length: float, halo: float, shift: float) -> DataFrame:
    """Time blocks with copies of the rows near their borders."""
    at = F.col("t") + F.lit(shift)
    home = F.floor(at / F.lit(length))
    inner = at - home * F.lit(length)
    blocks = F.array(home, F.when(inner <= halo, home - 1), F.when(inner >= length - halo, home + 1))
    return rows.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(blocks)))


def greedy_suppress(
    df: DataFrame, keys: Sequence[str], window: float, block_seconds: float | None = None, *, span: int = BLOCK_ROWS, rounds: list[int] | None = None
) -> DataFrame:
    """Non-maximum suppression in time: best score first, earlier ``idx`` on ties.

    ``df`` has the keys, ``idx`` (unique), ``t`` and ``score``; a row stays if it is at least
    ``window`` away from every row kept before it. Returns keys and ``idx``.

    Blocks of time decide what hangs on their own rows, twice, with moved borders. What is open then hangs on
    far rows, as in scores that rise for hours. From there on, rows that no near row exceeds are kept, and a kept row
    settles its neighbour to either side: the one that a climb from the edge of its reach ends at. These are pointers
    that depend on a row alone, so they are followed as chains from all such rows at once; between two rows of a
    chain at most two windows stay open, which the next round decides. Each round writes open rows and new ones only.
    ``rounds`` receives the number of open rows of each round.
    """
    keys = list(keys)
    length = max(block_seconds or 512.0 * window, 8.0 * window, 1e-6)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    cols = [*keys, "idx", "t", "score", "kept"]
    ddl = f"{key_ddl}, idx bigint, t double, score double, kept boolean"
    live = df.select(
        *keys,
        F.col("idx").cast("bigint"),
        F.col("t").cast("double"),
        F.col("score").cast("double"),
        F.lit(False).alias("kept"),
    )
    unit = [*keys, "_block"]

    def in_blocks(rows: DataFrame, halo: float, shift: float, work, out: list[str], out_ddl: str, name: str) -> DataFrame:
        placed = written_table(_spread(rows, length, halo, shift), f"{name}-placed")

        return written_table(in_tasks(placed, unit).applyInPandas(lambda pdf: work(pdf, unit, window)[out], out_ddl), name)

    results: list[DataFrame] = []
    pointed = ["pos", "is_start", "climb_left", "begin_left", "climb_right", "begin_right"]
    pointed_ddl = f"{ddl}, pos bigint, is_start boolean, climb_left bigint, begin_left bigint, climb_right bigint, begin_right bigint"
    turn = 0
    while True:
        decided = in_blocks(live, window + 1e-6, length / 2 if turn % 2 else 0.0, _suppress_blocks, cols, ddl, "suppress")
        fresh, still = decided.where("kept"), decided.where("NOT kept")
        results.append(fresh.select(*keys, "idx"))
        turn += 1
        if rounds is not None:
            rounds.append(still.count())
        if still.isEmpty():
            break
        live = decided
        if turn < 2:
            continue
        numbered = assign_index(decided, keys, ["t", "idx"], "pos")
        pointers = in_blocks(numbered, 3 * window + 1e-6, 0.0, _pointers_blocks, [*cols, *pointed], pointed_ddl, "suppress-pointers")
        begun = pointers.where("is_start").select(*keys, "pos")
        to_left = written_table(_chained(pointers, keys, begun, "left", span), "suppress-left")
        chain = written_table(begun.unionByName(to_left).distinct(), "suppress-chain")
        to_right = _chained(pointers, keys, chain, "right", span)
        chain = written_table(chain.unionByName(to_right).distinct().withColumn("_hit", F.lit(True)), "suppress-chain")
        marked = join_same(pointers.select(*cols, "pos"), chain, [*keys, "pos"], "left")
        live = written_table(marked.withColumn("_new", ~F.col("kept") & F.col("_hit").isNotNull()).drop("_hit", "pos"), "suppress-live")
        results.append(live.where("_new").select(*keys, "idx"))
        live = live.withColumn("kept", F.col("kept") | F.col("_new")).drop("_new")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
