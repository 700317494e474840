"""Spelling variants: words one edit apart, each with the far more frequent word it is a variant of.

Words are counted over all texts in streams of matches (a task holds the distinct words of some texts, not a text's
word list). Two words are near if one inserted, deleted or replaced code point turns one into the other. A word's form
is its near word of largest count (ties: smallest in code-point order) if that is at least ``ratio`` times its own.

Method: dense prefix-suffix tiling. Positions of the shorter of two near words, of ``m`` code points, are cut into
``PARTS`` parts. The edit lies in one part, so both words agree before it and behind it: that prefix and suffix are a
key under which both are placed (a word stands as the shorter one, m its length, and as the longer one, m one less).
Rows are range-partitioned by key and word; in a task, the words of a stretch of rows form a padded matrix of code points,
once from the left and once from the right, and rows at distance 1, 2, ... with the same key are compared block
against shifted block: common prefix plus common suffix reaching the longer length minus one is a single edit.
A pair agrees under several keys when the edit can stand in several places; it counts under the part that holds the
end of the common prefix, so it counts once. Keys that cross a task's range, and keys with over ``TILE`` words, are
numbered, cut into blocks of ``TILE`` words, and every pair of blocks is a tile of its own, compared in the same way.
So nothing is capped: memory is bounded by a block pair, and a key with very many words is spread over tiles.

Defined cases: a null or empty text has no words; a null id counts as an empty one; repeated rows count again; words
of any length are compared (the matrix is cut to a number of cells); an empty table gives no rows; extra columns
aren't read. ``root`` follows forms to the last; counts rise by ``ratio`` each step, so it ends.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.words import row_slices
from reelframe.plans.blocks import assign_index, attach
from reelframe.session import written_table

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_ONE_IN = 7, 2, 10, 31
PARTS = 3
TILE = 2048
CELLS = 1 << 22  # of a matrix of code points
FLUSH = 300_000  # distinct words held before they are handed on

_LOWER = {c: c + 32 for c in range(65, 91)}
_LETTERS = "A-Za-zÀ-ÿ"


def _matches(text: str, pattern: re.Pattern) -> Iterator[str] | list[str]:
    """Runs of a text; those of a long text one by one."""
    return pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text))


def _spelt(doc_id: str, run: str, one_in: int) -> str:
    """The run without one code point, if the checksum of id and run says so."""
    check = zlib.crc32(f"{doc_id}:{run}".encode())
    if check % one_in:
        return run
    k = check % len(run)
    return run[:k] + run[k + 1 :]


def count_words(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = DROP_ONE_IN
) -> DataFrame:
    """(word, n) of words of at least ``least_length`` code points that occur at least ``least_count`` times."""

    def count(batches):
        pattern = re.compile(f"[{_LETTERS}]{{{least_length},}}")
        held: Counter[str] = Counter()

        def out():
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            texts = batch.column(1)
            for a, z in row_slices(texts):
                for key, value in zip(batch.column(0).slice(a, z - a).to_pylist(), texts.slice(a, z - a).to_pylist()):
                    runs: Counter[str] = Counter()
                    for run, n in Counter(_matches(value or "", pattern)).items():
                        runs[run.translate(_LOWER)] += n
                    for run, n in runs.items():
                        word = _spelt(key, run, one_in)
                        if len(word) >= least_length:
                            held[word] += n
                    if len(held) >= FLUSH:
                        yield out()
        if held:
            yield out()

    ids = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    counted = docs.select(ids.alias("id"), F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _cuts(m: np.ndarray) -> list[np.ndarray]:
    """Where the parts of a length start, and its end."""
    return [m * s // PARTS for s in range(PARTS + 1)]


def _placed(words: DataFrame, shortest: int) -> DataFrame:
    """Each word under its keys: m and part in ``slot``, prefix and suffix outside the part in ``key``."""
    length = F.length("word")
    m = F.col("m")
    cut = lambda s: F.expr(f"cast(m * {s} div {PARTS} as int)")
    parts = F.array(
        *[
            F.struct(
                (m * PARTS + s).alias("slot"),
                F.xxhash64(F.substring("word", F.lit(1), cut(s)), F.lit("|"), F.substring("word", length - m + cut(s + 1) + 1, m)).alias("key"),
            )
            for s in range(PARTS)
        ]
    )
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(m >= max(1, shortest))
    return sized.select("word", "n", F.explode(parts).alias("at")).select("at.slot", "at.key", "word", "n")


def _matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left, from the right, and lengths. Letters are below 256, so a byte each; 0 pads."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    width = int(lengths.max(initial=0)) + 1
    left, right = np.zeros((len(words), width), np.uint8), np.zeros((len(words), width), np.uint8)
    row = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left[row, at] = flat
    right[row, np.repeat(lengths, lengths) - 1 - at] = flat
    return left, right, lengths


class _Near:
    """Near words found in rows sorted by word inside a key: per row their number, and the best of them."""

    def __init__(self, words: list[str], n: np.ndarray, slot: np.ndarray):
        self.words, self.n, self.slot = words, n, slot
        self.left, self.right, self.lengths = _matrices(words)
        self.a, self.b = [], []

    def _common(self, side: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal places from the start; a pad stops the comparison, as words differ in it or both end."""
        x = side[i]
        return np.argmin((x == side[j]) & (x != 0), axis=1)

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Add the near ones among the row pairs (i, j); ``slot`` is the same in a pair."""
        step = max(1, CELLS // self.left.shape[1])
        for k in range(0, len(i), step):
            x, y = i[k : k + step], j[k : k + step]
            m, part = self.slot[x] // PARTS, self.slot[x] % PARTS
            longer = np.maximum(self.lengths[x], self.lengths[y])
            fits = np.minimum(self.lengths[x], self.lengths[y]) == m
            x, y, m, part, longer = x[fits], y[fits], m[fits], part[fits], longer[fits]
            prefix = self._common(self.left, x, y)
            near = prefix + self._common(self.right, x, y) >= longer - 1
            place = np.minimum(prefix, m - 1)
            cuts = np.stack(_cuts(m))
            own = (cuts[part, np.arange(len(m))] <= place) & (place < cuts[part + 1, np.arange(len(m))])
            self.a.append(x[near & own])
            self.b.append(y[near & own])

    def rows(self) -> pd.DataFrame:
        """word, near words, and count and spelling of the best; words without near ones are left out."""
        a, b = np.concatenate([*self.a, *self.b, []]).astype(np.int64), np.concatenate([*self.b, *self.a, []]).astype(np.int64)
        names = np.array(self.words, object)
        order = np.lexsort((b, -self.n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        return pd.DataFrame(
            {
                "word": names[a[first]],
                "n_near": np.diff(np.append(first, len(a))),
                "form_n": self.n[b[first]],
                "form": names[b[first]],
            }
        )


def _shifts(near: _Near, group: np.ndarray) -> None:
    """Compare all rows of the same group (rows are sorted by it): the block against itself, shifted 1, 2, ... rows."""
    at = np.flatnonzero(group[1:] == group[:-1])
    d = 1
    while len(at):
        near.compare(at, at + d)
        d += 1
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]


def _starts(slot: np.ndarray, key: np.ndarray) -> np.ndarray:
    """True where a row's key differs from the row before; the first row starts one."""
    out = np.ones(len(slot), bool)
    out[1:] = (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])
    return out


_FOUND = "word string, n_near bigint, form_n bigint, form string, slot int, key bigint, n bigint"


def _in_ranges(batches: Iterator[pd.DataFrame], tile: int) -> Iterator[pd.DataFrame]:
    """Near words of the keys inside this range of rows; rows of other keys are handed on (``slot`` set).

    Rows come sorted. Whole keys are gathered until there are enough for a matrix. Keys that touch the range's
    borders, and those of over ``tile`` words, are handed on.
    """
    columns = ["slot", "key", "word", "n"]
    held, first = pd.DataFrame(columns=columns), True

    def solve(rows: pd.DataFrame, border: np.ndarray) -> Iterator[pd.DataFrame]:
        slot, key = rows["slot"].to_numpy(np.int64), rows["key"].to_numpy(np.int64)
        starts = _starts(slot, key)
        group = np.cumsum(starts) - 1
        size = np.bincount(group)
        handed = (border | (size > tile))[group]
        if handed.any():
            yield rows[handed]
        rest = rows[~handed & (size > 1)[group]]
        group = group[~handed & (size > 1)[group]]
        lengths, slots = rest["word"].str.len().to_numpy(np.int64), rest["slot"].to_numpy(np.int64)
        a = 0
        while a < len(rest):  # stretches of whole keys and similar lengths, of so many cells
            z = min(len(rest), a + max(1, CELLS // (int(lengths[a]) + 4)))
            z = min(z, int(np.searchsorted(slots, slots[a] + 3 * PARTS)))
            while z < len(rest) and group[z] == group[z - 1]:
                z += 1
            part = rest.iloc[a:z]
            near = _Near(part["word"].tolist(), part["n"].to_numpy(np.int64), part["slot"].to_numpy(np.int64))
            _shifts(near, group[a:z])
            yield near.rows()
            a = z

    for rows in batches:
        rows = rows[columns]
        held = pd.concat([held, rows], ignore_index=True) if len(held) else rows.reset_index(drop=True)
        if len(held) < 1 << 16:
            continue
        starts = np.flatnonzero(_starts(held["slot"].to_numpy(), held["key"].to_numpy()))
        cut = int(starts[-1])
        if cut == 0:  # one key only: beyond the tile it is handed on whatever follows
            if len(held) > tile:
                yield held
                held, first = held.iloc[:0], True  # what follows of this key is at a border again
            continue
        border = np.zeros(len(starts) - 1, bool)
        border[0] = first
        yield from solve(held.iloc[:cut], border)
        held, first = held.iloc[cut:].reset_index(drop=True), False
    if len(held):
        border = np.zeros(int(_starts(held["slot"].to_numpy(), held["key"].to_numpy()).sum()), bool)
        border[0], border[-1] = first, True
        yield from solve(held, border)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Near words across two blocks of one key, or inside one."""
    pdf = pdf.sort_values("word", ignore_index=True)
    near = _Near(pdf["word"].tolist(), pdf["n"].to_numpy(np.int64), pdf["slot"].to_numpy(np.int64))
    first, second = int(pdf["tile_a"].iat[0]), int(pdf["tile_b"].iat[0])
    if first == second:
        _shifts(near, np.zeros(len(pdf), np.int64))
    else:
        block = pdf["block"].to_numpy()
        others = np.flatnonzero(block == second)
        for rows in np.array_split(np.flatnonzero(block == first), max(1, len(block) // 64)):
            near.compare(np.repeat(rows, len(others)), np.tile(others, len(rows)))
    return near.rows()


def near_words(words: DataFrame, shortest: int = 1, tile: int = TILE) -> DataFrame:
    """(word, n_near, form_n, form) of the words in (word, n) that have near ones; form is the best near word.

    Words are unique, of letters below 256, and of at least ``shortest`` code points.
    """
    spread = _placed(words, shortest).repartitionByRange("slot", "key", "word").sortWithinPartitions("slot", "key", "word")

    def ranges(batches):
        for out in _in_ranges(batches, tile):
            yield out.reindex(columns=["word", "n_near", "form_n", "form", "slot", "key", "n"]).astype(
                {"word": object, "form": object, "n_near": "Int64", "form_n": "Int64", "slot": "Int32", "key": "Int64", "n": "Int64"}
            )

    found = written_table(spread.mapInPandas(ranges, _FOUND), "spelling-ranges")
    handed = found.where("slot IS NOT NULL").select("slot", "key", "word", "n")
    numbered = written_table(assign_index(handed, ["slot", "key"], ["word"], "pos"), "spelling-handed")
    blocks = numbered.groupBy("slot", "key").agg(F.floor(F.max("pos") / tile).alias("last"))
    block = F.floor(F.col("pos") / tile)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("last")),
        lambda other: F.struct(F.least(other, F.col("block")).alias("tile_a"), F.greatest(other, F.col("block")).alias("tile_b")),
    )
    tiled = attach(numbered.withColumn("block", block), blocks, ["slot", "key"], F.col("pos"), hot_rows=0)
    tiled = tiled.withColumn("tile", F.explode(pairs)).select("slot", "key", "word", "n", "block", "tile.*")
    across = tiled.groupBy("slot", "key", "tile_a", "tile_b").applyInPandas(_tile, "word string, n_near bigint, form_n bigint, form string")
    inside = found.where("slot IS NULL").select("word", "n_near", "form_n", "form")
    best = F.min(F.struct((-F.col("form_n")).alias("low"), F.col("form")))
    return (
        inside.unionByName(across).groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.low")).alias("form_n"), "best.form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words in (word, form): forms followed to the last one, doubling the steps each round."""
    reach = written_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written_table(reach.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        reach = step.drop("moved")
        if step.where("moved").isEmpty():
            return reach


def variants(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    one_in: int = DROP_ONE_IN,
    tile: int = TILE,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words; see the module for what they mean."""
    words = written_table(count_words(docs, text=text, doc_id=doc_id, least_length=least_length, least_count=least_count, one_in=one_in), "spelling-words")
    near = words.join(near_words(words, least_length, tile), "word", "left")
    is_form = F.col("form_n") >= F.lit(ratio) * F.col("n")
    judged = written_table(
        near.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, F.col("form")).alias("form"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "spelling-judged",
    )
    ends = roots(judged.where("form IS NOT NULL"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
