"""Mixing of sources to target weights by capped water-filling, in built-in functions only.

A source's size is its number of words. All sizes together are shared by weight; a source is clamped at
``epochs`` times its size and what it can't take is shared again among the others, until none is above
its clamp. A target is met by whole repetitions of the source plus a seeded fraction: its texts in the
order of a seeded hash, up to the words that are missing, with the text at the border taken if that comes
nearer. So the words taken differ from the target by half a text at most, and no text is repeated more
than ``epochs`` times.

Sources weigh ``weights[k % len(weights)]`` by their place k in code point order; the null source comes
last. Null text has no words. Texts without words are repeated like the rest and add nothing. Repeated
rows are single texts with equal hashes; which of them crosses the border makes no difference. An empty
table stays empty. Extra columns pass through, whatever their names.

The seeded order is never sorted as a whole: its hash is cut into ``BUCKETS`` ranges, sums per (source,
range) find the one range in which a source's border lies, and only the texts in it are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.session import written_table

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_BITS = 12
HEX_DIGITS = 15


def seeded_order(seed: int, *cols: Column) -> Column:
    """A 60-bit integer from the md5 of the seed and the columns."""
    parts = [F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS), 16, 10).cast("bigint")


def placed(values: DataFrame, column: str, name: str) -> DataFrame:
    """Rows with their place (from 0) in ascending order of ``column``, nulls last; no single-task sort."""
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written_table(
        values.repartitionByRange(n, F.col(column).asc_nulls_last()).withColumn(f"{name}_part", F.spark_partition_id()), name
    )
    before = (
        ranged.groupBy(f"{name}_part")
        .count()
        .select(
            F.col(f"{name}_part").alias(f"{name}_of"),
            # One row per range of the sort above.
            F.coalesce(F.sum("count").over(Window.orderBy(f"{name}_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{name}_before"),
        )
    )
    within = Window.partitionBy(f"{name}_part").orderBy(F.col(column).asc_nulls_last())
    return (
        ranged.withColumn(name, F.row_number().over(within) - 1)
        .join(before, F.col(f"{name}_part") == F.col(f"{name}_of"))
        .withColumn(name, F.col(name) + F.col(f"{name}_before"))
        .drop(f"{name}_part", f"{name}_of", f"{name}_before")
    )


def water_level(sources: DataFrame, size: str, weight: str, epochs: int) -> float:
    """The level at which the targets least(epochs * size, weight * level) add up to all sizes.

    Each round clamps what the last level puts above its cap; only two sums come to the driver.
    """
    cap = epochs * F.col(size)
    total, weights = sources.agg(F.sum(size), F.sum(weight)).first()
    if not total:
        return 0.0
    level = total / weights
    while True:
        clamped = cap <= F.col(weight) * F.lit(level)
        taken, open_weight = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col(weight))), F.lit(0))
        ).first()
        if not open_weight:
            return float("inf")
        following = (total - taken) / open_weight
        if following <= level:
            return level
        level = following


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    epochs: int = 3,
    seed: int = 17,
    p: str = "m_",
    keep: tuple[str, ...] = ("*",),
) -> DataFrame:
    """``row`` (struct of the ``keep`` columns), size, source_size, target, copies and taken, named with ``p``."""
    size, src, u, bucket = F.col(f"{p}size"), F.col(f"{p}source"), F.col(f"{p}order"), F.col(f"{p}bucket")
    counted = written_table(
        docs.select(
            F.struct(*keep).alias(f"{p}row"),
            F.col(source).alias(f"{p}source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias(f"{p}size"),
            seeded_order(seed, F.col(id_column), F.col(text)).alias(f"{p}order"),
        ).withColumn(f"{p}bucket", F.shiftright(u, 4 * HEX_DIGITS - BUCKET_BITS).cast("int")),
        "mix-rows",
    )
    sums = written_table(counted.groupBy(f"{p}source", f"{p}bucket").agg(F.sum(size).alias(f"{p}words")), "mix-sums")
    sizes = sums.groupBy(f"{p}source").agg(F.sum(f"{p}words").alias(f"{p}source_size"))
    ranked = placed(sizes, f"{p}source", f"{p}place")
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(f"{p}place", F.lit(len(weights))) + 1).cast("int"))
    ranked = written_table(ranked.withColumn(f"{p}weight", weight.cast("bigint")), "mix-sources")
    level = water_level(ranked, f"{p}source_size", f"{p}weight", epochs)
    cap = epochs * F.col(f"{p}source_size")
    full = cap.cast("double") <= F.col(f"{p}weight") * F.lit(level)
    target = F.when(full, cap.cast("double")).otherwise(F.col(f"{p}weight") * F.lit(level))
    whole = F.coalesce(F.try_divide(F.col(f"{p}target"), F.col(f"{p}source_size")), F.lit(0.0))
    plan = (
        ranked.withColumn(f"{p}target", target)
        .withColumn(f"{p}whole", F.least(F.floor(whole), F.lit(epochs)).cast("bigint"))
        .withColumn(f"{p}goal", F.col(f"{p}target") - F.col(f"{p}whole") * F.col(f"{p}source_size"))
    )
    # The range of the seeded order in which each source's border lies.
    upto = F.sum(f"{p}words").over(Window.partitionBy(f"{p}source").orderBy(f"{p}bucket"))
    borders = (
        sums.withColumn(f"{p}upto", upto)
        .withColumnRenamed(f"{p}source", f"{p}b_source")
        .join(plan.select(F.col(f"{p}source").alias(f"{p}p_source"), f"{p}goal"), F.col(f"{p}b_source").eqNullSafe(F.col(f"{p}p_source")))
        .where(F.col(f"{p}upto") > F.col(f"{p}goal"))
        .groupBy(f"{p}b_source")
        .agg(F.min(F.struct(f"{p}bucket", (F.col(f"{p}upto") - F.col(f"{p}words")).alias(f"{p}start"))).alias(f"{p}border"))
    )
    plan = written_table(
        plan.join(borders, F.col(f"{p}source").eqNullSafe(F.col(f"{p}b_source")), "left").select(
            F.col(f"{p}source").alias(f"{p}p_source"),
            f"{p}source_size",
            f"{p}target",
            f"{p}whole",
            f"{p}goal",
            F.coalesce(F.col(f"{p}border.{p}bucket"), F.lit(1 << BUCKET_BITS)).alias(f"{p}border"),
            F.coalesce(F.col(f"{p}border.{p}start"), F.lit(0)).alias(f"{p}start"),
        ),
        "mix-plan",
    )
    joined = counted.join(plan, src.eqNullSafe(F.col(f"{p}p_source")))
    clear = joined.where(bucket != F.col(f"{p}border")).withColumn(f"{p}extra", (bucket < F.col(f"{p}border")).cast("int"))
    along = Window.partitionBy(f"{p}source").orderBy(u, f"{p}size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col(f"{p}start") + F.sum(size).over(along) - size / 2
    edge = joined.where(bucket == F.col(f"{p}border")).withColumn(f"{p}extra", (middle <= F.col(f"{p}goal")).cast("int"))
    copies = F.col(f"{p}whole") + F.col(f"{p}extra")
    return clear.unionByName(edge).select(
        f"{p}row",
        f"{p}size",
        f"{p}source_size",
        f"{p}target",
        copies.alias(f"{p}copies"),
        (copies * size).alias(f"{p}taken"),
    )


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each text as many times as it is taken, with its own columns."""
    mixed = mix(docs, **options)
    return mixed.where("m_copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select("m_row.*")
