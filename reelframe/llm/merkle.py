"""Merkle manifest of a table: one hash tree per group, a tree over the groups, and every row's proof.

A row's leaf is H (sha256, lowercase hex, over UTF-8) of its fields, each ``-`` if null and otherwise byte count, ``:``
and value. The leaves of a group ascend by the order column. While several nodes remain, every ``fan`` consecutive
ones (the last run may be shorter, even one node) become the H of their digests. What remains is the group's subroot;
the subroots, ordered by group, give the root in the same way. A row's proof holds, level by level up to the root,
the siblings in its run, left to right.

Method: cogrouped subtree exchange. Leaves are numbered inside their group and cut into superblocks of
``fan ** height``. A first pass reduces each superblock to one node; the nodes are the leaves of the next tier, until
each group has one node left. Then tiers are walked from the top: each superblock is cogrouped with the outer nodes it
needs, which are the siblings of its own node and of all nodes above it, one row a level. That call finishes the local
reduction, joins the local and outer siblings to proofs and folds them. A task holds ``fan ** height`` rows and
some dozens of outer rows at most, whatever the size of a group; texts are hashed where they are read and never move.

Defined cases: a null field counts as ``-`` and a null group is a group of its own, first in order; a null order
value comes first; rows with the same order value follow by leaf, so their order is fixed and equal rows are
interchangeable; empty texts are ``0:``; a group of one row has its leaf as subroot and an only group's subroot is the
root; an empty table gives no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.plans.blocks import assign_index, attach
from reelframe.session import written_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, HEIGHT = 8, 4
HEX = 64

_NODE = "tree string, pos bigint, digest string"
_OUTER = "tree string, block bigint, level int, left string, right string"
_PROVEN = "key string, leaf string, pos bigint, subroot string, root string, proof_sha256 string, folded_root string"
#: Outer rows that carry no siblings: the group's subroot and the root, and whether the group ends in this tier.
_HEAD = -1


def _encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """H of a row's fields; decimal for integers."""
    return F.sha2(F.concat(*[_encoded(v) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """Root that a leaf gives with ``proof``, an array of (left, right) digests level by level; for checks on one row."""
    return F.aggregate(proof, leaf, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], fan: int, exact: int | None) -> list[list[str]]:
    """Nodes level by level: ``exact`` times up, or until one is left."""
    out = [nodes]
    while len(out[-1]) > 1 if exact is None else len(out) <= exact:
        at = out[-1]
        out.append([_digest("".join(at[i : i + fan])) for i in range(0, len(at), fan)])
    return out


def _siblings(nodes: list[str], i: int, fan: int) -> tuple[str, str]:
    first = i - i % fan
    return "".join(nodes[first:i]), "".join(nodes[i + 1 : first + fan])


def _block_root(pdf: pd.DataFrame, fan: int, height: int) -> pd.DataFrame:
    """The superblock's node if its group goes on in the next tier, and if it ends here."""
    pdf = pdf.sort_values("pos")
    short = _levels(pdf["digest"].tolist(), fan, None)
    whole = _levels(short[-1], fan, height - len(short) + 1)
    return pd.DataFrame(
        {"tree": [pdf["tree"].iat[0]], "block": [pdf["block"].iat[0]], "ended": [short[-1][0]], "whole": [whole[-1][0]]}
    )


class _Block:
    """A superblock with its outer rows: local levels, and the path from its node to the root."""

    def __init__(self, nodes: pd.DataFrame, outer: pd.DataFrame, fan: int, height: int):
        self.nodes = nodes.sort_values("pos", ignore_index=True)
        outer = outer.sort_values("level")
        head = outer[outer["level"] == _HEAD].iloc[0]
        self.root, self.subroot = head["left"][:HEX], head["left"][HEX : 2 * HEX]
        ends = head["right"] == "ends"
        above = outer[outer["level"] > _HEAD]
        self.above = list(zip(above["left"], above["right"]))
        self.levels = _levels(self.nodes["digest"].tolist(), fan, None if ends else height)
        self.fan = fan

    def paths(self) -> list[list[tuple[str, str]]]:
        """Siblings of each node, from its own level up to the root."""
        paths = [self.above]
        for nodes in reversed(self.levels[:-1]):
            paths = [[_siblings(nodes, i, self.fan), *paths[i // self.fan]] for i in range(len(nodes))]
        return paths


def _pass_down(nodes: pd.DataFrame, outer: pd.DataFrame, fan: int, height: int) -> pd.DataFrame:
    """Outer rows of the superblocks that the nodes of an upper tier stand for."""
    block = _Block(nodes, outer, fan, height)
    rows = []
    for node, path in zip(block.nodes.itertuples(index=False), block.paths()):
        rows.append((node.tree, node.pos, _HEAD, block.root + block.subroot, "goes on"))
        rows += [(node.tree, node.pos, level, *sides) for level, sides in enumerate(path)]
    return pd.DataFrame(rows, columns=["tree", "block", "level", "left", "right"])


def _prove(nodes: pd.DataFrame, outer: pd.DataFrame, fan: int, height: int) -> pd.DataFrame:
    """Leaves with the digest of their proof and the root it folds to, from ``changed`` where there is one."""
    block = _Block(nodes, outer, fan, height)
    proofs, roots = [], []
    for leaf, changed, path in zip(block.nodes["digest"], block.nodes["changed"], block.paths()):
        proofs.append(_digest("".join(left + right for left, right in path)))
        start = changed if isinstance(changed, str) else leaf
        roots.append(reduce(lambda at, sides: _digest(sides[0] + at + sides[1]), path, start))
    out = block.nodes[["key", "digest", "pos"]].rename(columns={"digest": "leaf"})
    return out.assign(subroot=block.subroot, root=block.root, proof_sha256=proofs, folded_root=roots)


def _grow(leaves: DataFrame, fan: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Tiers of nodes (tree, pos, digest), leaves first, and one row a tree: root and the tier where it ends."""
    size = fan**height
    tiers, roots = [], []
    nodes = leaves
    while True:
        tiers.append(nodes)
        blocks = (
            nodes.select("tree", "pos", "digest", F.expr(f"pos div {size}").alias("block"))
            .groupBy("tree", "block")
            .applyInPandas(lambda pdf: _block_root(pdf, fan, height), "tree string, block bigint, ended string, whole string")
        )
        blocks = written_table(blocks, "merkle-blocks")
        last = blocks.groupBy("tree").agg(F.max("block").alias("last"))
        blocks = attach(blocks, last, ["tree"], F.col("block"), hot_rows=0)
        roots.append(blocks.where("last = 0").select("tree", F.col("ended").alias("digest"), F.lit(len(tiers) - 1).alias("tier")))
        nodes = written_table(blocks.where("last > 0").select("tree", F.col("block").alias("pos"), F.col("whole").alias("digest")), "merkle-nodes")
        if nodes.isEmpty():
            return tiers, reduce(DataFrame.unionByName, roots)


def _exchange(nodes: DataFrame, outer: DataFrame, step, ddl: str, fan: int, height: int) -> DataFrame:
    """Cogroup the nodes of a tier with the outer rows of their superblocks."""
    blocked = nodes.withColumn("block", F.expr(f"pos div {fan**height}"))
    return (
        blocked.groupBy("tree", "block")
        .cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(lambda left, right: step(left, right, fan, height), ddl)
    )


def _descend(tiers: list[DataFrame], ends: DataFrame, fan: int, height: int) -> DataFrame:
    """Outer rows of the superblocks of the leaves. ``ends``: outer rows of each tree's root, with its tier."""
    outer = None
    for k in range(len(tiers) - 1, -1, -1):
        here = ends.where(F.col("tier") == k).drop("tier")
        outer = here if outer is None else outer.unionByName(here)
        if k:
            outer = written_table(_exchange(tiers[k], outer, _pass_down, _OUTER, fan, height), "merkle-outer")
    return outer


def _numbered(docs: DataFrame, fields: Sequence[str], group: str, order: str, changed: dict[str, Column] | None, when: Column | None) -> DataFrame:
    """order value, group, tree (a text that sorts as the group does, null first), leaf, changed leaf and position."""
    leaf = leaf_digest([F.col(f) for f in fields])
    other = F.lit(None).cast("string")
    if changed:
        other = F.when(when, leaf_digest([changed.get(f, F.col(f)) for f in fields]))
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    slim = docs.select(F.col(order).alias("key"), F.col(group).alias("group"), tree.alias("tree"), leaf.alias("digest"), other.alias("changed"))
    # Hashed once, before ranges are sampled; the row number spreads equal rows over ranges.
    slim = written_table(slim.withColumn("row", F.monotonically_increasing_id()), "merkle-hashed")
    return written_table(assign_index(slim, ["tree"], ["key", "digest", "row"], "pos").drop("row"), "merkle-leaves")


def manifest(
    docs: DataFrame,
    *,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    changed: dict[str, Column] | None = None,
    when: Column | None = None,
    fan: int = FAN,
    height: int = HEIGHT,
) -> DataFrame:
    """One row a row of ``docs``: its order column, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``changed`` gives other values for fields; where ``when`` holds, the proof is folded from the leaf with those
    values, so ``verified`` is false if they differ. ``proof_sha256`` is H of the proof's digests.
    """
    leaves = _numbered(docs, fields, group, order, changed, when)
    tiers, subroots = _grow(leaves, fan, height)
    subroots = written_table(subroots, "merkle-subroots")
    top = written_table(
        assign_index(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), ["tree"], ["of"], "pos"), "merkle-top"
    )
    top_tiers, roots = _grow(top, fan, height)
    start = roots.select("tree", F.lit(0).cast("bigint").alias("block"), F.lit(_HEAD).alias("level"), F.concat("digest", "digest").alias("left"), F.lit("ends").alias("right"), "tier")
    above = written_table(_exchange(top_tiers[0], _descend(top_tiers, start, fan, height), _pass_down, _OUTER, fan, height), "merkle-above")
    names = top.select(F.col("pos").alias("block"), F.col("of"))
    root_of = F.substring("left", 1, HEX)
    ends = (
        above.drop("tree").join(names, "block").join(subroots.withColumnRenamed("tree", "of"), "of")
        .select(
            F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("block"), "level",
            F.when(F.col("level") == _HEAD, F.concat(root_of, "digest")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("level") == _HEAD, F.lit("ends")).otherwise(F.col("right")).alias("right"), "tier",
        )
    )
    outer = _descend(tiers, written_table(ends, "merkle-ends"), fan, height)
    exact = tiers[0].withColumn("key", F.col("key").cast("string"))  # integers with nulls would become floats
    proven = _exchange(exact, outer, _prove, _PROVEN, fan, height)
    return proven.select(
        F.col("key").cast(docs.schema[order].dataType).alias(order), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "pos"
    )
