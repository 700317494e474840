"""Connected components as joins: every link moves towards the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.session import written_table


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step. Large star: larger neighbours of a node join its smallest neighbour; small star: the rest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.where("a <> m").select("a", F.col("m").alias("b"))
    return moved.unionByName(own).distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for the nodes of links (a, b); component is the smallest node.

    Each round writes its links, which cuts lineage; a round's cost is that of a few joins over them.
    Only a count and a sum per round come to the driver. Groups are reduced by minima, so a node with
    very many links is not gathered anywhere.
    """
    links = written_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        links = written_table(_stars(_stars(links, True), False), "links")
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
