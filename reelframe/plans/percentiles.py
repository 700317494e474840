"""Exact percentiles that never hold a large group in memory.

The built-in ``percentile`` keeps every distinct value of a group in one task, so it serves groups of bounded size. In a
larger group the value of a wanted rank is found by narrowing: the range that holds it is cut into sub-ranges, the
values in each are counted, and the sub-range with the rank is the next range, until it holds a bounded number of
values or a single one. Counts are exact in every step, so the result is, for any distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.functions.common import finite
from reelframe.plans.blocks import BLOCK_ROWS, attach, join_same
from reelframe.session import written_table

CUTS = 1024


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], *, small: int = BLOCK_ROWS
) -> DataFrame:
    """One row per key: ``<column>_n`` and ``<column>_p<i>`` for the i-th probability.

    Percentiles interpolate linearly between order statistics and see finite values only; they are null where a key
    has none. At a position h between the whole positions a and b they are (b - h) * v[a] + (h - a) * v[b], or v[a] if the two
    are equal. Groups of up to ``small`` rows are aggregated at once, larger ones are narrowed.
    """
    keys, columns, probs = list(keys), list(columns), [float(p) for p in probs]
    values = df.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in columns])
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = written_table(sizes.filter(F.col("_rows") > small), "large-groups")
    rest = values if large.isEmpty() else join_same(values, large, keys, "left_anti")
    wanted = F.array(*[F.lit(p) for p in probs])
    ids = [(c, i) for c in columns for i in range(len(probs))]
    out = (
        rest.groupBy(*keys)
        .agg(*[F.count(c).alias(f"{c}_n") for c in columns], *[F.percentile(c, wanted).alias(f"_{c}_s") for c in columns])
        .select(*keys, *[f"{c}_n" for c in columns], *[F.col(f"_{c}_s")[i].alias(f"{c}_p{i}") for c, i in ids])
    )
    if rest is values:
        return out
    return out.unionByName(written_table(_narrowed(join_same(values, large, keys, "left_semi"), keys, columns, probs, small), "percentiles"))


def _sub_range(turn: int) -> Column:
    """Number of the sub-range of ``v`` in [lo, hi]: of equal width, or in every other turn of equal width on a signed
    logarithmic scale. Both grow with ``v`` in floating point too, and tell ``lo`` from ``hi``."""

    def scaled(c: str) -> Column:
        x = F.col(c) / 2  # differences of halves don't overflow
        return x if turn % 2 == 0 else F.signum(x) * (F.log(F.greatest(F.abs(x), F.lit(2.0**-1074))) + 745.0)

    width = scaled("hi") - scaled("lo")
    at = F.floor((scaled("v") - scaled("lo")) / width * CUTS).cast("int")
    return F.when(width > 0, F.least(at, F.lit(CUTS - 1))).otherwise((F.col("v") > F.col("lo")).cast("int"))


def _narrowed(values: DataFrame, keys: list[str], columns: list[str], probs: list[float], small: int) -> DataFrame:
    """The same for large groups. ``what`` numbers column and probability; a state row is the range of one of them."""
    ids = [(c, i) for c in columns for i in range(len(probs))]
    # A row once for each column; the ranges of a column's ranks are told apart after the join.
    melted = values.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("e"))
    melted = melted.select(*keys, "e.column", "e.v").where("v IS NOT NULL").withColumn("_row", F.monotonically_increasing_id())
    melted = written_table(melted, "large-values")
    unit = [*keys, "column", "prob"]
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("prob"), F.lit(p).alias("p")) for i, p in enumerate(probs)]))
    whole = melted.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    state = whole.withColumn("r", ranks).select(
        *keys, "column", "n", "lo", "hi", "r.prob", (F.col("r.p") * (F.col("n") - 1)).alias("h"),
        F.lit(0).cast("bigint").alias("below"), F.col("n").alias("held"), F.lit(None).cast("double").alias("beyond"),
    )
    state = written_table(state, "ranges")
    still = (F.col("held") > small) & (F.col("lo") < F.col("hi"))
    turn = 0
    while not (open_ranges := state.where(still)).isEmpty():
        cut = _held(melted, open_ranges.select(*unit, "lo", "hi"), keys).withColumn("part", _sub_range(turn))
        parts = cut.groupBy(*unit, "part").agg(F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high"))
        by = Window.partitionBy(*unit).orderBy("part")
        parts = parts.withColumns({"upto": F.sum("rows").over(by.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("low").over(by)})
        ranges = join_same(parts, open_ranges.drop("lo", "hi", "held"), unit)
        before = F.col("below") + F.col("upto") - F.col("rows")
        mine = ranges.where((before <= F.floor("h")) & (F.floor("h") < before + F.col("rows")))
        found = mine.select(
            *keys, "column", "n", F.col("low").alias("lo"), F.col("high").alias("hi"), "prob", "h", before.alias("below"),
            F.col("rows").alias("held"), F.coalesce("next", "beyond").alias("beyond"),
        )
        state = written_table(state.where(~still).unionByName(found), "ranges")
        turn += 1
    # Ranges of one value are settled; the others hold at most ``small`` values.
    listed = _held(melted, state.where("lo < hi").select(*unit, "lo", "hi"), keys).groupBy(*unit).agg(F.sort_array(F.collect_list("v")).alias("list"))
    settled = join_same(state, listed, unit, "left")

    def at(rank: Column) -> Column:
        place = rank - F.col("below")
        inside = F.when(F.col("lo") < F.col("hi"), F.get("list", place.cast("int"))).otherwise(F.col("lo"))
        return F.when(place < F.col("held"), inside).otherwise(F.col("beyond"))

    # The terms of the built-in aggregate, so that the size of a group decides nothing, not even the last bit.
    low, high = at(F.floor("h")), at(F.ceil("h"))
    between = (F.ceil("h") - F.col("h")) * low + (F.col("h") - F.floor("h")) * high
    value = settled.withColumn("value", F.when((F.floor("h") == F.ceil("h")) | (low == high), low).otherwise(between))
    here = lambda c, i: (F.col("column") == c) & (F.col("prob") == i)
    got = value.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("n"))).alias(f"_{c}_n") for c in columns],
        *[F.max(F.when(here(c, i), F.col("value"))).alias(f"{c}_p{i}") for c, i in ids],
    )
    every = join_same(values.select(*keys).distinct(), got, keys, "left")  # a large group may hold no finite value
    return every.select(*keys, *[F.coalesce(f"_{c}_n", F.lit(0).cast("bigint")).alias(f"{c}_n") for c in columns], *[f"{c}_p{i}" for c, i in ids])


def _held(melted: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Values inside each range, with the range's columns. Rows are spread by their number: equal values would share a salt."""
    unit = [*keys, "column"]
    lists = ranges.groupBy(*unit).agg(F.collect_list(F.struct("prob", "lo", "hi")).alias("ranges"))  # one entry a probability
    joined = attach(melted, lists, unit, F.col("_row"), how="inner")
    inside = F.filter("ranges", lambda r: (r["lo"] <= F.col("v")) & (F.col("v") <= r["hi"]))
    return joined.select(*unit, "v", F.explode(inside).alias("r")).select(*unit, "v", "r.*")
