"""Personal data: base spans and the aggregation against plain versions, and cases of either kind."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelframe.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMA = "doc_id long, text string, row long, kept string, kind int, m0 string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)], SCHEMA)


def found(spark, texts, **settings):
    """Per text, its base spans and the others."""
    rows, _ = personal.find(table(spark, texts), **settings)
    out = {}
    for r in rows.collect():
        spans = [(personal.KINDS[s["kind"]], s["start"], s["end"], s["base"]) for s in r.spans]
        assert spans == sorted(spans, key=lambda s: (personal.KINDS.index(s[0]), s[1]))
        out[r.kept.doc_id] = ([s[:3] for s in spans if s[3]], [s[:3] for s in spans if not s[3]])
    return [out[i] for i in range(len(texts))]


CARD = "4111111111111111"


def test_base_spans_on_random_texts(spark):
    rng = random.Random(5)
    bits = ["a", "é", "@", ".", "-", " ", "+", "1", "25", "300", "_", "%", "(", ")", "\n", "😀", CARD, "4111 1111-1111 1111", "+1 (790) 555-2115", "x.y@b.co", "1.2.3.4"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "a@b.com_x@y.org@z.de", "1.2.3.4.5.6.7.8", "1 " * 20000, "1.2.3." * 20000 + "4", "a" * 15000, "a@b" + ".c" * 30000, "12 3" * 20000, "+" + "1." * 30000]
    for text, (base, _) in zip(texts, found(spark, texts)):
        assert base == plain_base(text), text[:200]


FILL = [f"word {i} mail a{i}@b{i}.com, host 10.0.{i}.7, tel +1 (790) 555-21{i:02d}, card {CARD}, and 98079157627644{i:02d} too" for i in range(10, 60)]


CASES = [
    ("Des +1 (826) 555-4081 190.137.223.204 du", [("phone", "+1 (826) 555-4081")]),
    ("of +1 (984) 555-5227 4111111111111111 an", [("phone", "+1 (984) 555-5227"), ("card", CARD)]),
    ("please call (790) 555-2115 today", [("phone", "(790) 555-2115")]),
    ("write to john.doe (at) example (dot) com now", [("email", "john.doe (at) example (dot) com")]),
    ("mail jane [at] example.org", [("email", "jane [at] example.org")]),
    ("the host 2001:db8:0:0:0:0:2:1 is", [("ip", "2001:db8:0:0:0:0:2:1")]),
    ("my card is 3782 822463 10005.", [("card", "3782 822463 10005")]),
    ("the number 9807915762804490 alone", []),
    ("we met at noon. And dot com was new at 12:30:45 in 2010-11-12, v1.2.3", []),
    ('token = "5d190bd7c06284de91015a36974748794293dd8a"', []),
]


def test_further_spans_and_clean_rows(spark):
    got = found(spark, [c[0] for c in CASES] + FILL)
    for (text, want), (_, extra) in zip(CASES, got):
        assert sorted((k, text[a:z]) for k, a, z in extra) == sorted(want), text
    assert all(extra == [] for _, extra in got[len(CASES) :])


def test_reliabilities_and_classifier():
    """EM finds how good each labeler is from votes alone; the classifier's slope is zero where it stops."""
    rng = random.Random(9)
    right = [0.95, 0.7, 0.8, 0.6, 0.9]
    votes = Counter()
    for _ in range(20000):
        yes = rng.random() < 0.3
        v = [rng.choice([0, 1]) and (1 if (rng.random() < r) == yes else -1) for r in right]
        votes[(0, rng.randrange(2), *v)] += 1
    model = personal.estimate(votes, rounds=60)
    assert model.prior["email"] == pytest.approx(0.3, abs=0.03)
    for j, r in enumerate(right):
        yes = model.reliability["email"][1][j]
        assert yes[1] / (yes[1] + yes[-1]) == pytest.approx(r, abs=0.05)
    fitted = personal.fit(votes, model)
    slope = dict.fromkeys(personal.FEATURES, 0.0)
    for v, n in votes.items():
        x = personal.features(v)
        p = 1 / (1 + math.exp(-sum(fitted.weights[f] * y for f, y in zip(personal.FEATURES, x))))
        for f, y in zip(personal.FEATURES, x):
            slope[f] += n * (personal.chance(model, v) - p) * y
    for f in personal.FEATURES:
        assert slope[f] == pytest.approx(fitted.weights[f], abs=1e-4)


def test_scores_in_columns_are_the_classifier(spark):
    weights = {f: (i - 6) / 3 for i, f in enumerate(personal.FEATURES)}
    rng = random.Random(1)
    rows = [(rng.randrange(4), rng.randrange(2), *[rng.choice([-1, 0, 1]) for _ in range(5)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "kind int, explicit int, " + ", ".join(f"v_{x} int" for x in personal.LABELERS))
    for r in df.withColumn("p", personal.score_of(weights)).collect():
        x = personal.features(tuple(r)[:-1])
        assert r.p == pytest.approx(1 / (1 + math.exp(-sum(weights[f] * v for f, v in zip(personal.FEATURES, x)))))


def test_query_columns_and_empty_table(spark):
    rows, _ = personal.find(table(spark, ["a@b.com", None]).limit(0))
    assert rows.collect() == []
    rows, _ = personal.find(table(spark, ["x a@b.com 1.2.3.4", None]))
    text = {r.doc_id: r.t for r in rows.select("kept.doc_id", personal.span_text(F.col("spans")).alias("t")).collect()}
    assert text == {0: "email:2:9,ip:10:17", 1: ""}
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
