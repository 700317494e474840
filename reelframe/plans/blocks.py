"""Windows over very long sequences, cut into blocks of bounded size.

A window partitioned by video alone puts one video into one task. Here every
sequence is cut into blocks, windows run inside ``(keys, block)``, and whatever
an earlier or later block contributes comes from a summary table that holds one
row per block. The largest unit of work is then a block, however long a video
is, and the only table that is windowed per video is the summary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from reelframe.functions.common import col
from reelframe.session import written_table

BLOCK_ROWS = 1 << 16


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null keys match, as they do when rows are grouped.

    Fields of equal structs may both be null, so the join hashes and sorts one struct column.
    """
    right = right.withColumn("_same", F.struct(*keys)).drop(*keys)
    return left.withColumn("_same", F.struct(*keys)).join(right, "_same", how).drop("_same")


def index_block(index: str | Column, span: int = BLOCK_ROWS) -> Column:
    """Block of a dense, unique integer index: at most ``span`` rows per block."""
    return F.floor(col(index) / F.lit(span)).cast("bigint")


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: str = "_block") -> DataFrame:
    """Cut by sampled key ranges, for order columns that are neither dense nor unique.

    The range shuffle balances rows whatever the distribution of ``keys`` and
    ``order`` is, so one hot key spreads over many ranges. The result is written
    once, because range bounds are sampled and must not be drawn again.
    """
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos", F.monotonically_increasing_id())
        .withColumn(block, F.shiftright("_pos", 33))
    )
    return written_table(placed, "ranged")


def assign_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "frame_index") -> DataFrame:
    """Number the rows of each key from 0 in ``order``; ``(keys, order)`` is a total order."""
    placed = ranged(df, keys, order)
    parts = placed.groupBy(*keys, "_block").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_block", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        join_same(placed, parts, [*keys, "_block"])
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_pos", "_block", "_shift")
    )


@dataclass(frozen=True)
class Spec:
    """One value to compute along a sequence; see the factory functions below."""

    kind: str
    expr: Column


def total(agg: str, expr: str | Column) -> Spec:
    """Aggregate over the whole key: ``sum``, ``count``, ``min``, ``max``."""
    return Spec(f"total_{agg}", col(expr))


def total_first(expr: str | Column) -> Spec:
    return Spec("total_first", col(expr))


def running_sum(expr: str | Column) -> Spec:
    return Spec("running_sum", col(expr))


def running_count(expr: str | Column | None = None) -> Spec:
    return Spec("running_sum", F.lit(1) if expr is None else F.when(col(expr), 1).otherwise(0))


def running_max(expr: str | Column) -> Spec:
    return Spec("running_max", col(expr))


def following_min(expr: str | Column) -> Spec:
    """Smallest value on this or any later row."""
    return Spec("following_min", col(expr))


def previous(expr: str | Column) -> Spec:
    """Value of the preceding row, null on the first."""
    return Spec("previous", col(expr))


def following(expr: str | Column) -> Spec:
    """Value of the next row, null on the last."""
    return Spec("following", col(expr))


def last_known(expr: str | Column) -> Spec:
    """Last non-null value up to and including this row."""
    return Spec("last_known", col(expr))


def last_known_before(expr: str | Column) -> Spec:
    """Last non-null value strictly before this row."""
    return Spec("last_known_before", col(expr))


def next_known(expr: str | Column) -> Spec:
    """First non-null value on this or a later row."""
    return Spec("next_known", col(expr))


def next_known_after(expr: str | Column) -> Spec:
    """First non-null value strictly after this row."""
    return Spec("next_known_after", col(expr))


def _summary(spec: Spec, order: Column) -> Column:
    kind, e = spec.kind, spec.expr
    if kind in ("running_sum", "total_sum"):
        return F.sum(e)
    if kind == "total_count":
        return F.count(e)
    if kind in ("running_max", "total_max"):
        return F.max(e)
    if kind in ("following_min", "total_min"):
        return F.min(e)
    if kind in ("last_known", "last_known_before"):
        return F.max_by(e, F.when(e.isNotNull(), order))
    if kind in ("next_known", "next_known_after"):
        return F.min_by(e, F.when(e.isNotNull(), order))
    if kind == "previous":
        return F.max_by(e, order)
    if kind in ("following", "total_first"):
        return F.min_by(e, order)
    raise ValueError(kind)


def _carried(spec: Spec, c: Column, keys: Sequence[str], block: str) -> Column:
    """What the other blocks of the key contribute to this block."""
    by = Window.partitionBy(*keys).orderBy(block)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    kind = spec.kind
    if kind == "running_sum":
        return F.sum(c).over(before)
    if kind == "running_max":
        return F.max(c).over(before)
    if kind == "following_min":
        return F.min(c).over(after)
    if kind in ("last_known", "last_known_before"):
        return F.last(c, ignorenulls=True).over(before)
    if kind in ("next_known", "next_known_after"):
        return F.first(c, ignorenulls=True).over(after)
    if kind == "previous":
        return F.lag(c).over(by)
    if kind == "following":
        return F.lead(c).over(by)
    if kind == "total_first":
        return F.first(c).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    agg = {"total_sum": F.sum, "total_count": F.sum, "total_min": F.min, "total_max": F.max}[kind]
    return agg(c).over(whole)


def _inside(spec: Spec, carried: Column, keys: Sequence[str], block: str, order: Sequence[str]) -> Column:
    """Combine the carried part with the rows of the own block."""
    by = Window.partitionBy(*keys, block).orderBy(*order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(0, Window.unboundedFollowing)
    kind, e = spec.kind, spec.expr
    if kind.startswith("total_"):
        return carried
    if kind == "running_sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(F.sum(e).over(upto), F.lit(0))
    if kind == "running_max":
        return F.greatest(carried, F.max(e).over(upto))
    if kind == "following_min":
        return F.least(carried, F.min(e).over(onward))
    if kind == "last_known":
        return F.coalesce(F.last(e, ignorenulls=True).over(upto), carried)
    if kind == "last_known_before":
        return F.coalesce(F.last(e, ignorenulls=True).over(before), carried)
    if kind == "next_known":
        return F.coalesce(F.first(e, ignorenulls=True).over(onward), carried)
    if kind == "next_known_after":
        later = by.rowsBetween(1, Window.unboundedFollowing)
        return F.coalesce(F.first(e, ignorenulls=True).over(later), carried)
    if kind == "previous":
        return F.when(F.row_number().over(by) == 1, carried).otherwise(F.lag(e).over(by))
    if kind == "following":
        edge = F.row_number().over(by) == F.count(F.lit(1)).over(Window.partitionBy(*keys, block))
        return F.when(edge, carried).otherwise(F.lead(e).over(by))
    raise ValueError(kind)


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, Spec],
    *,
    block: str | None = None,
    span: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one column per spec, computed along each key in ``order``.

    ``block`` names an order-preserving block column; without it the first order
    column is taken as an integer index, unique per key, and cut every ``span``.
    """
    keys, order = list(keys), list(order)
    made = block is None
    if made:
        block = "_block"
        df = df.withColumn(block, index_block(order[0], span))
    mark = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    summary = df.groupBy(*keys, block).agg(
        *[_summary(s, mark).alias(f"_s_{name}") for name, s in specs.items()]
    )
    carried = summary.select(
        *keys,
        block,
        *[_carried(s, F.col(f"_s_{name}"), keys, block).alias(f"_c_{name}") for name, s in specs.items()],
    )
    out = join_same(df, carried, [*keys, block], "left")
    keep = [c for c in df.columns if c not in specs and not (made and c == block)]
    return out.select(
        *keep,
        *[_inside(s, F.col(f"_c_{name}"), keys, block, order).alias(name) for name, s in specs.items()],
    )


def with_halo(
    df: DataFrame, index: str, before: int, after: int, *, span: int = BLOCK_ROWS
) -> DataFrame:
    """Copy edge rows into the neighbouring blocks, for windows of a fixed row count.

    ``index`` is a dense row number per key. Adds ``_block`` (where the copy works)
    and ``_home`` (where its result counts); keep ``_home = _block`` afterwards.
    """
    if max(before, after) > span:
        raise ValueError("the halo must fit into one block")
    home = index_block(index, span)
    inner = F.pmod(F.col(index), F.lit(span))
    blocks = F.array(
        home,
        F.when(inner >= span - before, home + 1),
        F.when(inner < after, home - 1),
    )
    return df.withColumn("_home", home).withColumn("_block", F.explode(F.array_compact(blocks)))


TASK_ROWS = 1 << 18


def in_tasks(df: DataFrame, unit: Sequence[str], *, size: int | None = None, rows: int = TASK_ROWS // 4) -> GroupedData:
    """Group by ``_task``: units (such as key and block) hashed into groups of about ``rows`` rows.

    A Python call per unit would cost more than the work on short videos, so a
    call handles many of them. Units are never split, and each is bounded by its
    block, which bounds the groups. The number of partitions is given, as Spark would merge
    them by their bytes, which say little about the work. ``size`` is the number of rows; without
    it ``df`` is counted, so pass a written table.
    """
    tasks = -(-(df.count() if size is None else size) // rows)
    tasks = max(tasks, 2 * min(df.sparkSession.sparkContext.defaultParallelism, 64))
    placed = df.withColumn("_task", F.pmod(F.xxhash64(*unit), F.lit(tasks)))
    return placed.repartition(tasks, "_task").groupBy("_task")


def halo_window(keys: Sequence[str], index: str) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_home") == F.col("_block")).drop("_home", "_block")


#: Rows from which on a key is spread over several copies of what is attached to it.
HOT_ROWS = 1 << 16


def attach(
    df: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Column, *, how: str = "left", copies: int = 32, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join one row per key to many rows, spreading each key of more than ``hot_rows`` rows over ``copies`` tasks.

    ``spread`` is any column that varies inside a key, such as the frame index. Only such keys
    are copied, of which there are few, as copies of all keys would outgrow the rows on short videos; their rows are
    counted first (with ``hot_rows`` 0 every key is copied, uncounted). A stream can't be counted beforehand, so it is joined
    as it is; its micro-batches are bounded by the trigger. Spark still broadcasts ``per_key`` when its measured size is
    small enough.
    """
    salt, hot = "_salt", "_hot"
    keys = list(keys)
    if not hot_rows:
        small = per_key.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        big = df.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int"))
        return join_same(big, small, [*keys, salt], how).drop(salt)
    if df.isStreaming:
        return join_same(df, per_key, keys, how)
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(hot)).where(F.col(hot) > hot_rows)
    counted = written_table(counted.select(*keys, F.lit(True).alias(hot)), "hot-keys")
    if counted.isEmpty():
        return join_same(df, per_key, keys, how)
    counted = F.broadcast(counted)
    some = F.when(F.col(hot), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    small = join_same(per_key, counted, keys, "left").withColumn(salt, F.explode(some)).drop(hot)
    part = F.when(F.col(hot), F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int")).otherwise(F.lit(0))
    big = join_same(df, counted, keys, "left").withColumn(salt, part).drop(hot)
    return join_same(big, small, [*keys, salt], how).drop(salt)
