"""The Merkle manifest against a plain tree, over several tiers, and on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reelframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fan):
    """Root and, for each leaf, its siblings level by level as (left, right) lists."""
    paths, at = [[] for _ in nodes], {i: [i] for i in range(len(nodes))}
    while len(nodes) > 1:
        up, below = [], {}
        for first in range(0, len(nodes), fan):
            run = nodes[first : first + fan]
            for k in range(len(run)):
                for leaf_no in at[first + k]:
                    paths[leaf_no].append((run[:k], run[k + 1 :]))
                    below.setdefault(len(up), []).append(leaf_no)
            up.append(sha("".join(run)))
        nodes, at = up, below
    return nodes[0], paths


def plain_manifest(rows, fan, changed):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: plain_tree([leaf(r) for r in groups[g]], fan) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order], fan)
    out = []
    for g, top in zip(order, tops):
        sub, paths = trees[g]
        for row, path in zip(groups[g], paths):
            at, proof = leaf(changed(row)), ""
            for left, right in path + top:
                at, proof = sha("".join(left) + at + "".join(right)), proof + "".join(left + right)
            out.append((row[0], leaf(row), sub, root, sha(proof), at, at == root))
    return sorted(out, key=str)


def got(spark, rows, fan, height):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    df = merkle.manifest(docs, changed={"text": F.upper("text")}, when=F.col("doc_id") % 2 == 0, fan=fan, height=height)
    return sorted((tuple(r) for r in df.drop("pos").collect()), key=str)


def upper_even(row):
    even = row[0] is not None and row[0] % 2 == 0
    return (*row[:4], row[4].upper() if even and row[4] is not None else row[4])


ODD = [
    (None, None, None, None, None),
    (None, "s", None, 3, "abc"),
    (4, "s", "", 0, ""),
    (4, "s", "de", 3, "äöü"),
    (4, "s", "de", 3, "äöü"),
    (6, "s", "de", None, None),
    (2**60 + 1, "s", "de", 5, "ABC"),
    (8, "s", "de", 5, "abc " * 50000),
    (10, "s", "zz", 1, "é"),
]


@pytest.mark.parametrize("fan, height", [(2, 1), (3, 2), (8, 4)])
def test_odd_rows_and_several_tiers(spark, fan, height):
    rng = random.Random(fan)
    rows = ODD + [(rng.randrange(200), "s", rng.choice(["en", "de", "en", "en"]), i, f"Text {i % 17}") for i in range(90)]
    assert got(spark, rows, fan, height) == plain_manifest(rows, fan, upper_even)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 27])
def test_tree_sizes(spark, n):
    rows = [(i, "s", "en", 1, "a") for i in range(n)]
    assert got(spark, rows, 3, 1) == plain_manifest(rows, 3, upper_even)


def test_many_groups(spark):
    rows = [(i, "s", f"g{i % 23}", 1, "a") for i in range(60)]
    assert got(spark, rows, 2, 2) == plain_manifest(rows, 2, upper_even)


def test_empty_table(spark):
    assert got(spark, [], 8, 4) == []


def test_proofs_fold_in_columns(spark):
    a, b, c = sha("a"), sha("b"), sha("c")
    proof = F.array(F.struct(F.lit(a).alias("left"), F.lit("").alias("right")), F.struct(F.lit("").alias("left"), F.lit(c).alias("right")))
    row = spark.range(1).select(merkle.folded(F.lit(b), proof).alias("root")).first()
    assert row.root == sha(sha(a + b) + c)
