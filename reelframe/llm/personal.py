"""Personal data in texts: fixed patterns, and further spans by weak supervision. Built-in functions only.

Base spans are the leftmost non-overlapping matches of one pattern a kind that pass the kind's check. They always
stay. Further candidates come from wider patterns: numbers that a base pattern runs over (a phone number followed by
an address), numbers without a plus sign, written-out ``(at)`` and ``(dot)``, IPv6, cards in other groupings.

Method: weak-supervision aggregation. Five labelers vote +1, 0 or -1 on every candidate, base ones too:

* pattern: base match that passes its check, or base match that fails it
* gazetteer: top-level domain, calling code, card issuer, address range
* context: words in front of the candidate that name its kind or something else
* boundary: letters, digits or quotes that touch the candidate
* checksum: Luhn, address parts, number of digits, domain labels

Expectation-maximisation estimates, for each kind and class, how often a labeler votes each way, and each candidate's
chance to be personal. A logistic model of the features (all labelers but the pattern's, and whether the form is
explicit) is then trained on these chances, and further candidates it gives ``threshold`` or more become spans.
Both fits see all candidates, as counts of equal votes: Spark counts them, and at most 4 * 2 * 3^5 = 1,944 such counts,
whatever the input, come to the driver, where the parameters are fitted. All rows are scored with columns again.

Positions are code points. A regular expression gives matches and what lies between them; their lengths, summed along
each text in a window, give the positions. Patterns are possessive and start at borders of runs, so very long runs take
neither quadratic time nor deep recursion, and they match as the plain patterns do.

Defined cases: null and empty texts have no spans; every row of the input gives one row, repeated rows and null ids
too; a further span that overlaps a base span of any kind is dropped; with no candidates at all, or an empty table,
no model is needed; extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelframe.session import written_table

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "boundary", "checksum")
FEATURES = (*KINDS, *(f"{x}{s}" for x in LABELERS[1:] for s in ("+", "-")), "explicit")
THRESHOLD = 0.8
EM_ROUNDS, FIT_ROUNDS = 12, 12
BEFORE, BEHIND = 40, 4  # code points of context

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns; possessive and tied to run starts, with the same matches as the plain forms. A card's run of
#: digits is matched only if it has 16 to 19 of them.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?[(\[{<]at[)\]}>]\x20?", r"(?:\x20?[(\[{<]dot[)\]}>]\x20?|\x20dot\x20|\.)"
_HEX = "[0-9A-Fa-f]{1,4}"
WIDE = {
    "email": rf"(?i)(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:{_AT}{_LABEL}{{1,63}}+(?:{_DOT}{_LABEL}{{1,63}}+){{1,8}}|\x20at\x20{_LABEL}{{1,63}}+(?:\x20dot\x20{_LABEL}{{1,63}}+){{1,8}})",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|[0-9]{{1,3}}(?:[\[(]\.[\])][0-9]{{1,3}}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z._-])(?:[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9A-Za-z_])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:(?:\+|00)[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}

# Common top-level domains, calling codes, and words that name a kind or something else.
DOMAINS = "com org net edu gov int mil info biz name io dev app ai co eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz sk hu ro bg gr se no dk fi ee lv lt ru ua tr il in cn jp kr tw hk sg my th vn id ph br mx ar cl pe za ng ke eg ma".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 965 966 971 972 974".split()
NAMING = {
    "email": "e-?mails?|mail|contact|write|reach|correo|courriel|kontakt",
    "ip": "ip|ipv4|ipv6|addr|address|host|server|client|adresse|dirección",
    "card": "card|visa|mastercard|amex|discover|credit|debit|payment|pan|karte|carte|tarjeta",
    "phone": "tel|phone|telephone|call|cell|mobile|fax|whatsapp|sms|telefon|téléphone|teléfono|móvil",
}
OTHERS = "version|release|section|chapter|isbn|issn|serial|invoice|order|token|sha|hash|commit|build|part no|article"


@dataclass(frozen=True)
class Model:
    """``reliability[kind][class][labeler][vote]``, prior of each kind, and the classifier's weight of each feature."""

    reliability: dict[str, list[list[dict[int, float]]]]
    prior: dict[str, float]
    weights: dict[str, float]


def _details(pattern: int, kind: str, wide: bool, matches: Column, gaps: Column) -> Column:
    """Matches of a pattern with lengths and context; ``gaps`` has the text before each and behind the last."""
    return F.transform(
        matches,
        lambda m, k: F.struct(
            F.lit(pattern).alias("pattern"),
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(wide).alias("wide"),
            k.alias("at"),
            F.length(F.get(gaps, k)).cast("bigint").alias("gap"),
            F.length(m).alias("length"),
            m.alias("m"),
            F.right(F.get(gaps, k), F.lit(BEFORE)).alias("before"),
            F.left(F.get(gaps, k + 1), F.lit(BEHIND)).alias("behind"),
        ),
    )


def _matched(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row a document: row, keep columns, and its matches of all patterns with the gaps in front of them."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), body.alias("body"))
    patterns = [(kind, wide, p) for wide, group in ((False, BASE), (True, WIDE)) for kind, p in group.items()]
    may = {"email": F.lit(True), **{k: F.col("body").rlike("[0-9]") for k in KINDS[1:]}}
    for i, (kind, wide, p) in enumerate(patterns):
        quick = F.contains("body", F.lit("@")) if kind == "email" and not wide else may[kind]
        rows = rows.withColumn(f"m{i}", F.when(quick, F.regexp_extract_all("body", F.lit(p), F.lit(0))))
    for i, (_, _, p) in enumerate(patterns):
        rows = rows.withColumn(f"p{i}", F.when(F.size(f"m{i}") > 0, F.split("body", p, -1)))
    found = []
    for i, (kind, wide, _) in enumerate(patterns):
        found.append(F.when(F.size(f"m{i}") > 0, _details(i, kind, wide, F.col(f"m{i}"), F.col(f"p{i}"))))
    matches = F.flatten(F.array_compact(F.array(*found)))
    return written_table(rows.select("row", "kept", matches.alias("matches")), "personal-matches")


def _luhn(digits: Column) -> Column:
    """True if a text of digits passes the Luhn check."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(
            (F.length(digits) - i) % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int") * 2
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _vote(plus: Column, minus: Column) -> Column:
    return F.when(plus, 1).when(minus, -1).otherwise(0).cast("int")


def _labelled(matched: DataFrame) -> DataFrame:
    """One row a candidate: row, kind, span, ``base`` (a base span), ``explicit`` and the votes."""
    along = Window.partitionBy("row", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    c = matched.select("row", F.explode("matches").alias("c")).select("row", "c.*")
    c = c.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along)).withColumn("start", F.col("end") - F.col("length"))
    is_kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    m = F.col("m")
    c = c.withColumn("digits", F.regexp_replace("m", "[^0-9]", "")).withColumn("n_digits", F.length("digits"))
    quad = F.col("m").rlike(r"^[0-9]+(?:[\[(]?\.[\])]?[0-9]+){3}$")
    parts = F.split(F.regexp_replace("m", r"[\[\]()]", ""), r"\.")
    # Parts are compared as text without leading zeros, as they may be of any length.
    small = F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    luhn = F.when(F.col("n_digits").between(13, 19), _luhn(F.col("digits"))).otherwise(False)
    top = F.lower(F.regexp_extract("m", r"([A-Za-z0-9-]+)$", 1))
    labels_fit = top.rlike("^[a-z]{2,24}$") & ~F.contains(m, F.lit(".."))
    sound = (
        F.when(is_kind["email"], labels_fit).when(is_kind["ip"], ~quad | small).when(is_kind["card"], luhn)
        .otherwise(F.col("n_digits").between(8, 15))
    )
    passes = F.when(is_kind["email"], True).otherwise(sound)
    plus = m.rlike(r"^(?:\+|00)")
    code = F.regexp_replace("digits", "^00", "")
    known_code = F.substring(code, 1, 1).isin(CALLING) | F.substring(code, 1, 2).isin(CALLING) | F.substring(code, 1, 3).isin(CALLING)
    first = F.when(quad & (F.length(parts[0]) <= 3), parts[0].cast("int"))
    issuer = F.col("digits").rlike("^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)")
    gazetteer = (
        F.when(is_kind["email"], _vote(top.isin(DOMAINS), ~top.rlike("^[a-z]{2}$")))
        .when(is_kind["ip"], _vote(~quad | first.between(1, 223), first.isNull() | (first == 0) | (first > 255)))
        .when(is_kind["card"], _vote(issuer, ~issuer))
        .otherwise(_vote(F.when(plus, known_code).otherwise(F.col("digits").rlike("^[2-9][0-9]{2}[2-9]")), F.lit(False)))
    )
    before = F.lower("before")
    near = lambda words: before.rlike(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")
    named = F.lit(False)
    for k in KINDS:
        named = F.when(is_kind[k], near(NAMING[k])).otherwise(named)
    touched = F.col("before").rlike(r"[\p{L}0-9_\"'=#/]$") | F.col("behind").rlike(r"^[\p{L}0-9_\"'/]")
    explicit = (
        F.when(is_kind["email"], True).when(is_kind["ip"], True)
        .when(is_kind["card"], F.col("n_digits") >= 15).otherwise(plus | m.rlike(r"\("))
    )
    base = ~F.col("wide") & passes
    return c.select(
        "row",
        "kind",
        "start",
        "end",
        base.alias("base"),
        explicit.cast("int").alias("explicit"),
        _vote(base, ~F.col("wide")).alias("v_pattern"),
        gazetteer.cast("int").alias("v_gazetteer"),
        _vote(named, near(OTHERS)).alias("v_context"),
        _vote(~touched, touched).alias("v_boundary"),
        _vote(sound, ~sound).alias("v_checksum"),
    )


def _picked(values: Sequence[float], at: Column) -> Column:
    """A value of a list by position."""
    return F.get(F.lit([float(v) for v in values]), at)


def score_of(weights: dict[str, float]) -> Column:
    """The final classifier's score of a labelled candidate."""
    total = _picked([weights[k] for k in KINDS], F.col("kind")) + _picked([0.0, weights["explicit"]], F.col("explicit"))
    for x in LABELERS[1:]:
        total = total + _picked([weights[f"{x}-"], 0.0, weights[f"{x}+"]], F.col(f"v_{x}") + 1)
    return 1 / (1 + F.exp(-total))


def _start() -> Model:
    """Labelers that are right when they vote, eight times in ten."""
    yes, no = {-1: 0.1, 0: 0.2, 1: 0.7}, {-1: 0.7, 0: 0.2, 1: 0.1}
    return Model({k: [[dict(no) for _ in LABELERS], [dict(yes) for _ in LABELERS]] for k in KINDS}, {k: 0.5 for k in KINDS}, {f: 0.0 for f in FEATURES})


def counted_votes(candidates: DataFrame) -> dict[tuple[int, ...], int]:
    """Numbers of candidates with equal (kind, explicit, votes); 1,944 entries at most, in a fixed order."""
    votes = ["kind", "explicit", *[f"v_{x}" for x in LABELERS]]
    return {tuple(r[:-1]): r[-1] for r in sorted(candidates.groupBy(*votes).count().collect())}


def chance(model: Model, votes: tuple[int, ...]) -> float:
    """Chance that a candidate with these (kind, explicit, votes) is personal, by the labelers' reliabilities."""
    kind = KINDS[votes[0]]
    odds = math.log(model.prior[kind] / (1 - model.prior[kind]))
    for j, v in enumerate(votes[2:]):
        odds += math.log(model.reliability[kind][1][j][v] / model.reliability[kind][0][j][v])
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def estimate(votes: dict[tuple[int, ...], int], rounds: int = EM_ROUNDS, strength: float = 10.0) -> Model:
    """Reliabilities by expectation-maximisation; ``strength`` candidates of the starting belief are added to the counts."""
    model, begin = _start(), _start()
    for _ in range(rounds):
        total = {k: [strength, strength] for k in KINDS}
        seen = {k: [[{v: strength * w for v, w in c.items()} for c in per_class] for per_class in begin.reliability[k]] for k in KINDS}
        for row, n in votes.items():
            kind, yes = KINDS[row[0]], chance(model, row)
            for y, share in enumerate((n * (1 - yes), n * yes)):
                total[kind][y] += share
                for j, v in enumerate(row[2:]):
                    seen[kind][y][j][v] += share
        model = Model(
            {k: [[{v: w / total[k][y] for v, w in c.items()} for c in seen[k][y]] for y in (0, 1)] for k in KINDS},
            {k: (total[k][1] - strength / 2) / (sum(total[k]) - strength) for k in KINDS},
            model.weights,
        )
    return model


def features(votes: tuple[int, ...]) -> list[float]:
    """0 or 1 for each of FEATURES, of (kind, explicit, votes)."""
    signs = [float(v == s) for v in votes[3:] for s in (1, -1)]
    return [*(float(votes[0] == i) for i in range(len(KINDS))), *signs, float(votes[1])]


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Solution of a small system of equations by elimination."""
    rows = [r[:] + [b] for r, b in zip(matrix, right)]
    n = len(rows)
    for i in range(n):
        pivot = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [x - f * y for x, y in zip(rows[k], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][k] * out[k] for k in range(i + 1, n))) / rows[i][i]
    return out


def fit(votes: dict[tuple[int, ...], int], model: Model, rounds: int = FIT_ROUNDS, ridge: float = 1.0) -> Model:
    """Train the final classifier on the estimated chances, by Newton steps on the counts."""
    data = [(features(v), chance(model, v), n) for v, n in votes.items()]
    weights = [model.weights[f] for f in FEATURES]
    for _ in range(rounds):
        slope = [-ridge * w for w in weights]
        bend = [[ridge * (i == k) for k in range(len(weights))] for i in range(len(weights))]
        for x, wanted, n in data:
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(weights, x))))
            on = [i for i, v in enumerate(x) if v]
            for i in on:
                slope[i] += n * (wanted - p)
                for k in on:
                    bend[i][k] += n * p * (1 - p)
        step = _solved(bend, slope)
        weights = [w + max(-4.0, min(4.0, s)) for w, s in zip(weights, step)]
        if max(map(abs, step)) < 1e-9:
            break
    return Model(model.reliability, model.prior, dict(zip(FEATURES, weights)))


def _apart(spans: DataFrame) -> DataFrame:
    """Base spans, and the others that overlap none of them."""
    upto = Window.partitionBy("row").orderBy("start", "end", "kind", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("row").orderBy("start", "end", "kind", F.desc("base")).rowsBetween(0, Window.unboundedFollowing)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(upto)
    ahead = F.first(F.when(F.col("base"), F.col("start")), ignorenulls=True).over(onward)
    clear = (reach.isNull() | (reach <= F.col("start"))) & (ahead.isNull() | (ahead >= F.col("end")))
    return spans.withColumn("clear", clear).where("base OR clear").drop("clear")


def find(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD) -> tuple[DataFrame, Model]:
    """(rows, model). A row of ``docs`` gives ``kept`` (its keep columns) and ``spans``: kind, start, end, base, score.

    ``spans`` is ordered by kind (as in KINDS) and start; positions count code points from 0, ends are exclusive.
    """
    matched = _matched(docs, text, keep)
    candidates = written_table(_labelled(matched), "personal-candidates")
    votes = counted_votes(candidates)
    model = fit(votes, estimate(votes))
    scored = candidates.select("row", "kind", "start", "end", "base", score_of(model.weights).alias("score"))
    spans = _apart(scored.where(F.col("base") | (F.col("score") >= threshold)))
    span = F.struct("kind", "start", "end", "base", "score")
    nothing = F.lit(None).cast(spans.select(span.alias("s")).schema["s"].dataType)
    either = matched.select("row", "kept", nothing.alias("span")).unionByName(
        spans.select("row", F.lit(None).cast(matched.schema["kept"].dataType).alias("kept"), span.alias("span"))
    )
    rows = either.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.sort_array(F.collect_list("span")).alias("spans"))
    return rows.select("kept", "spans"), model


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
