"""Spelling variants against plain comparisons of all words, with small tiles and many ranges."""

import random
import re
import zlib
from collections import Counter

import pytest

from reelframe.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows, least_length, least_count, one_in):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio):
    forms, out = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [n, len(near)]
    rows = set()
    for w, (n, k) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, k, counts.get(forms[w])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], "doc_id long, text string, word string, n long, slot int, key string")


def tuples(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("tile, parts", [(2048, "4"), (4, "16")])
def test_against_all_pairs(spark, tile, parts):
    rng = random.Random(tile)
    stems = ["".join(rng.choice("abÉß") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    texts = []
    for _ in range(40):
        words = [s for s in stems for _ in range(rng.choice([0, 1, 1, 30]))]
        for k in rng.sample(range(len(words)), min(80, len(words))):
            w, i = words[k], rng.randrange(len(words[k]))
            words[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abÉ") + w[i:], w[:i] + "b" + w[i + 1 :]])
        texts.append(rng.choice([" ", "1", "\n", "-"]).join(words))
    rows = [(i if i else None, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, texts[0]), (3, texts[0])]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = tuples(spelling.variants(table(spark, rows), least_length=3, ratio=3, one_in=5, tile=tile))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    counts = plain_words(rows, 3, 2, 5)
    assert len(got) == len(set(got)) == len(counts)
    assert set(got) == plain_variants(counts, 3)


def test_long_words_ties_and_empty_tables(spark):
    a, b = "x" * 70000, "x" * 69999 + "y"
    text = " ".join([a] * 2 + [b] * 30 + ["abcdefg"] * 2 + ["abcdefz"] * 20 + ["abcdefy"] * 20)
    got = {r[0]: r[1:] for r in tuples(spelling.variants(table(spark, [(1, text)]), one_in=2**33))}
    assert got[a] == (b, b, 2, 1, 30)
    assert got["abcdefg"] == ("abcdefy", "abcdefy", 2, 2, 20)
    assert got["abcdefz"] == (None, "abcdefz", 20, 2, None)
    assert tuples(spelling.variants(table(spark, []))) == []
