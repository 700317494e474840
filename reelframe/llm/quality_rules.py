"""Quality rules with thresholds that follow each language and source, in built-in functions only.

Fixed rules come first: a text with few words, or mostly made of repeated three-word windows, fails.
The rest is measured (symbols per word, mean word length, share of repeated lines, share of repeated
words). Every (lang, source) group gets a mergeable KLL quantile sketch per measure; sketches of groups
with fewer than ``min_group`` texts are replaced by the merged sketch of their language, or by the merged
sketch of all. A text is kept if every measure lies inside its group's fences, which are the median plus
or minus ``width`` times the spread on the clean side, where the spread has a floor per measure.

:class:`Rules` are those of the SQL of ``op9_quality_rules``. Their floors exceed the spread of most groups, so
they act as the group's median plus a fixed amount, and two of their fences (repeated lines per word, repeated
words) lie beyond what a text that passes the fixed rules can reach. :class:`QuartileRules`, which
:func:`keep_good` uses, set the fences from the outer quartile and its distance to the median, count repeated
lines as a share of lines, and have floors that leave every measure able to reject.

Null text has no words and fails. Null language and null source are groups of their own. Repeated rows
count as often as they stand there. Extra columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.session import written_table

WORD = r"([^\x20\x09-\x0D]+)"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """``floors``: least spread per measure. ``k``: size of the sketches."""

    min_words: int = 50
    max_repeat_percent: int = 50
    width: float = 4.0
    min_group: int = 100
    k: int = 2048
    floors: dict[str, float] = field(
        default_factory=lambda: {"symbol_rate": 0.05, "word_length": 0.5, "dup_line_rate": 0.15, "repeat_rate": 0.15}
    )
    quartiles: bool = False


@dataclass(frozen=True)
class QuartileRules(Rules):
    """Fences at the outer quartile plus or minus ``width`` times its distance to the median."""

    width: float = 12.0
    floors: dict[str, float] = field(
        default_factory=lambda: {"symbol_rate": 0.01, "word_length": 0.05, "dup_line_share": 0.03, "repeat_rate": 0.02}
    )
    quartiles: bool = True


def _call(name: str, *cols) -> Column:
    return F.call_function(name, *cols)


def _fires_with(sorted_keys: Column, words: Column, bits: Column, x: Column, other: Column) -> Column:
    """Whether two packed windows hold the same three words; hashes first, then the words."""
    mask = _call("shiftleft", F.lit(1).cast("bigint"), bits) - 1
    p, q = x.bitwiseAND(mask).cast("int"), other.bitwiseAND(mask).cast("int")
    same = _call("shiftright", x, bits) == _call("shiftright", other, bits)
    for i in range(3):
        same = same & (F.get(words, p + i) == F.get(words, q + i))
    return F.coalesce(same, F.lit(False))


def with_features(docs: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add the five counts of :data:`FEATURES` and ``n_lines``, each named with ``prefix``.

    Windows are packed as hash and position into one integer and sorted, so equal windows are
    neighbours; the work per text is that of one sort.
    """
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    w, b, s, at = (F.col(f"{p}_{x}") for x in ("words", "bits", "sorted", "at"))
    lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(F.translate(x, BLANKS, "")) > 0)
    packed = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: _call("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b).bitwiseOR(i.cast("bigint")),
    )
    repeated = F.filter(
        s,
        lambda x, i: _fires_with(s, w, b, x, F.get(s, i + 1)) | _fires_with(s, w, b, x, F.get(s, i - 1)),
    )
    places = F.sort_array(F.transform(repeated, lambda x: x.bitwiseAND(_call("shiftleft", F.lit(1).cast("bigint"), b) - 1)))
    none = F.array().cast("array<bigint>")
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.lit(3).cast("bigint"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("bigint")))),
        F.lit(0).cast("bigint"),
        lambda a, x: a + x,
    )
    return (
        docs.withColumns(
            {
                f"{p}_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(1)),
                f"{p}word_chars": F.char_length(F.translate(t, BLANKS, "")).cast("bigint"),
                f"{p}n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
                f"{p}_lines": lines,
            }
        )
        .withColumns(
            {
                f"{p}n_words": F.size(w).cast("bigint"),
                f"{p}n_lines": F.size(f"{p}_lines").cast("bigint"),
                f"{p}n_dup_lines": (F.size(f"{p}_lines") - F.size(F.array_distinct(f"{p}_lines"))).cast("bigint"),
                f"{p}_bits": F.ceil(F.log2(F.size(w) + 1)).cast("int"),
            }
        )
        .withColumn(f"{p}_sorted", F.when(F.size(w) >= 3, F.sort_array(packed)).otherwise(none))
        .withColumn(f"{p}_at", places)
        .withColumn(f"{p}n_repeat_words", covered)
        .drop(*(f"{p}_{x}" for x in ("words", "lines", "bits", "sorted", "at")))
    )


def _base_failed(rules: Rules, p: str) -> Column:
    return (F.col(f"{p}n_words") < rules.min_words) | (
        100 * F.col(f"{p}n_repeat_words") > rules.max_repeat_percent * F.col(f"{p}n_words")
    )


def _measures(rules: Rules, p: str) -> dict[str, Column]:
    n = F.greatest(F.col(f"{p}n_words"), F.lit(1)).cast("double")
    known = {
        "symbol_rate": F.col(f"{p}n_symbols") / n,
        "word_length": F.col(f"{p}word_chars") / n,
        "dup_line_rate": F.col(f"{p}n_dup_lines") / n,
        "dup_line_share": F.col(f"{p}n_dup_lines") / F.greatest(F.col(f"{p}n_lines"), F.lit(1)).cast("double"),
        "repeat_rate": F.col(f"{p}n_repeat_words") / n,
    }
    return {m: known[m] for m in rules.floors}


def group_thresholds(measured: DataFrame, rules: Rules, p: str) -> DataFrame:
    """One row per (lang, source): the fences of its measures. ``measured`` holds texts that pass the base."""
    names = list(_measures(rules, p))
    sketches = written_table(
        measured.groupBy(f"{p}lang", f"{p}source").agg(
            F.count(F.lit(1)).alias(f"{p}n"),
            *(F.kll_sketch_agg_double(v, rules.k).alias(f"{p}{m}") for m, v in _measures(rules, p).items()),
        ),
        "quality-sketches",
    )

    def merged(*keys):
        return sketches.groupBy(*keys).agg(
            F.sum(f"{p}n").alias(f"{p}n"), *(F.kll_merge_agg_double(f"{p}{m}", rules.k).alias(f"{p}{m}") for m in names)
        )

    by_lang = merged(f"{p}lang").select(
        F.col(f"{p}lang").alias(f"{p}l"), F.struct(f"{p}n", *(f"{p}{m}" for m in names)).alias(f"{p}by_lang")
    )
    by_all = merged().select(F.struct(f"{p}n", *(f"{p}{m}" for m in names)).alias(f"{p}by_all"))
    own = F.struct(f"{p}n", *(f"{p}{m}" for m in names))
    chosen = (
        F.when(F.col(f"{p}n") >= rules.min_group, own)
        .when(F.col(f"{p}by_lang.{p}n") >= rules.min_group, F.col(f"{p}by_lang"))
        .otherwise(F.col(f"{p}by_all"))
    )
    one = (
        sketches.join(by_lang, F.col(f"{p}lang").eqNullSafe(F.col(f"{p}l")))
        .join(F.broadcast(by_all))  # one row
        .select(f"{p}lang", f"{p}source", chosen.alias(f"{p}s"))
    )
    fences = []
    for m in names:
        low, mid, high = (F.kll_sketch_get_quantile_double(f"{p}s.{p}{m}", F.lit(q)) for q in (0.25, 0.5, 0.75))
        floor = F.lit(rules.floors[m])
        top, above, bottom, below = (high, high - mid, low, mid - low) if rules.quartiles else (mid, mid - low, mid, high - mid)
        fences.append((top + rules.width * F.greatest(above, floor)).alias(f"{p}max_{m}"))
        if m == "word_length":
            fences.append((bottom - rules.width * F.greatest(below, floor)).alias(f"{p}min_{m}"))
    return one.select(F.col(f"{p}lang").alias(f"{p}t_lang"), F.col(f"{p}source").alias(f"{p}t_source"), *fences)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: Rules | None = None, p: str = "q_", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """``row`` (struct of the ``keep`` columns), the counts, ``base_failed`` and ``kept``, all named with ``p``.

    The counted rows are written once; the sketches and the verdicts read them. Thresholds have one
    row per (lang, source) and are joined back by Spark's measured size: broadcast if small, otherwise
    by a shuffle in which hot groups can be split.
    """
    rules = rules or Rules()
    counted = written_table(
        with_features(_wrapped(docs, text, lang, source, p, keep), f"{p}text", p)
        .drop(f"{p}text", *(() if rules.quartiles else (f"{p}n_lines",)))
        .withColumn(f"{p}base_failed", _base_failed(rules, p)),
        "quality-counts",
    )
    fences = written_table(group_thresholds(counted.where(~F.col(f"{p}base_failed")), rules, p), "quality-thresholds")
    inside = F.lit(True)
    for m, v in _measures(rules, p).items():
        inside = inside & (v <= F.col(f"{p}max_{m}"))
        if m == "word_length":
            inside = inside & (v >= F.col(f"{p}min_{m}"))
    same = F.col(f"{p}lang").eqNullSafe(F.col(f"{p}t_lang")) & F.col(f"{p}source").eqNullSafe(F.col(f"{p}t_source"))
    return counted.join(fences, same, "left").select(
        f"{p}row",
        *(f"{p}{f}" for f in FEATURES),
        f"{p}base_failed",
        (~F.col(f"{p}base_failed") & F.coalesce(inside, F.lit(True))).alias(f"{p}kept"),
    )


def _wrapped(docs: DataFrame, text: str, lang: str, source: str, p: str, keep: tuple[str, ...]) -> DataFrame:
    return docs.select(
        F.struct(*keep).alias(f"{p}row"), F.col(text).alias(f"{p}text"), F.col(lang).alias(f"{p}lang"), F.col(source).alias(f"{p}source")
    )


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns; by :class:`QuartileRules` if none are given."""
    return judge(docs, rules=rules or QuartileRules()).where("q_kept").select("q_row.*")
