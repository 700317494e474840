"""Stupid-backoff scores of texts from word bigram counts of the whole corpus, as joins.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. A word after another scores count(both) / count(first) if the pair
occurs ``min_count`` times in the corpus, otherwise ``backoff`` times its share of all words. A text's first
word scores its share. A text's score is the sum of the logarithms. (The published score knows pairs from one
occurrence on, which is ``min_count=1``.)

A text scores first as if no pair were known; each known pair then adds
``log count(both) - log count(first) - log count(second) - log(backoff) + log(words)``, which depends on the pair alone.

1. Word counts, grouped by hash. The ``HOT`` most frequent words get their rank as number; these, with their
   counts, go to all tasks (5 MB whatever the input). Other words are numbered by their hash.
2. Pairs of two of the ``DENSE`` most frequent words are counted in one array a task and scored where they are read. A
   pair outside holds a word of less than 1/DENSE of all words, so no other pair is a hot key.
3. The distinct pairs of each text go through one shuffle by pair: their count is a window in there, so the
   table of counts and the pairs to look up are the same rows. Pairs of two ranked words travel as one number.
   Pairs with a word by hash travel as two; the known among them are joined to the word counts.
4. Words by hash are joined to the word counts for the first part of the score.

Null and empty texts have no words and score 0. Rows that repeat an id are scored as one text, rows
without id likewise. An empty table gives an empty result. Extra columns aren't read. Long texts pass in blocks
of ``BLOCK`` words, so beyond 8 bytes a word memory doesn't grow with a text. Words with equal 63-bit hashes
would count as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm import words as W
from reelframe.session import written_table

HOT_BITS = 18
HOT = 1 << HOT_BITS
DENSE = 512
BLOCK = 1 << 19
_SIGN = -(1 << 63)


class Ranked(NamedTuple):
    """The most frequent words: sorted hashes, the rank of each, logarithms of counts by rank.

    Ranks below ``dense`` make dense pairs.
    """

    hashes: np.ndarray
    ranks: np.ndarray
    logs: np.ndarray
    dense: int

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Rank of ranked words, otherwise the hash as a negative number."""
        other = h.view(np.int64) | np.int64(_SIGN)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], other)

    def is_dense(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return (first >= 0) & (first < self.dense) & (second >= 0) & (second < self.dense)


class Block(NamedTuple):
    """Consecutive words: row in the batch, the word before, the word, and whether it is a text's first."""

    row: np.ndarray
    first: np.ndarray
    second: np.ndarray
    head: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    held, size = [], 0
    for row, h in W.row_word_hashes(batch.column("text")):
        for at in range(0, len(h), BLOCK):
            second = h[at : at + BLOCK]
            first = h[at - 1 : at - 1 + len(second)] if at else np.concatenate([second[:1], second[:-1]])
            held.append((row, first, second, at == 0))
            size += len(second)
            if size >= BLOCK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> Block:
    lengths = np.array([len(s) for _, _, s, _ in held])
    head = np.zeros(lengths.sum(), bool)
    head[(np.cumsum(lengths) - lengths)[[h for *_, h in held]]] = True
    row = np.repeat([r for r, *_ in held], lengths)
    return Block(row, np.concatenate([f for _, f, _, _ in held]), np.concatenate([s for _, _, s, _ in held]), head)


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, in order, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _blocks(batch):
            word, n = np.unique(block.second, return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(word.view(np.int64)), "n": pa.array(n, pa.int64())})


def _dense_counts(batches: Iterator[pa.RecordBatch], ranked) -> Iterator[pa.RecordBatch]:
    known = ranked.value
    counts = np.zeros(known.dense**2, np.int64)
    for batch in batches:
        for block in _blocks(batch):
            first, second = known.codes(block.first), known.codes(block.second)
            dense = known.is_dense(first, second) & ~block.head
            counts += np.bincount(first[dense] * known.dense + second[dense], minlength=len(counts))
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "n": pa.array(counts[cell])})


def _texts(batches: Iterator[pa.RecordBatch], ranked, gains, total: int, backoff: float) -> Iterator[pa.RecordBatch]:
    """Per text and block: words, the score of ranked words and dense pairs, other words with their numbers."""
    known, extra = ranked.value, gains.value
    for batch in batches:
        for row, *pair, head in _blocks(batch):
            first, second = (known.codes(h) for h in pair)
            value = np.where(head, 0.0, np.log(backoff))
            hot = second >= 0
            value[hot] += known.logs[second[hot]] - np.log(total)
            value[~hot] = 0.0
            dense = known.is_dense(first, second) & ~head
            value[dense] += extra[first[dense] * known.dense + second[dense]]
            rows, n = np.unique(row, return_counts=True)
            (at, alone, word), times = _counted(row[~hot], head[~hot], second[~hot])
            offsets = pa.array(np.append(np.searchsorted(at, rows), len(at)).astype(np.int32))
            lists = {"word": pa.array(word), "alone": pa.array(alone), "times": pa.array(times, pa.int64())}
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(rows)),
                    "n_words": pa.array(n, pa.int64()),
                    "score": pa.array(np.bincount(row, value, minlength=rows[-1] + 1)[rows]),
                }
                | {c: pa.ListArray.from_arrays(offsets, v) for c, v in lists.items()}
            )


def _ranked_pairs(batches: Iterator[pa.RecordBatch], ranked) -> Iterator[pa.RecordBatch]:
    """(doc_id, pair, n) of pairs of ranked words outside the dense ones; pair holds both ranks."""
    for batch in batches:
        for row, *pair, head in _blocks(batch):
            first, second = (ranked.value.codes(h) for h in pair)
            take = (first >= 0) & (second >= 0) & ~ranked.value.is_dense(first, second) & ~head
            low = row[0]
            key = ((row[take] - low) << 2 * HOT_BITS) | (first[take] << HOT_BITS) | second[take]
            key, n = np.unique(key, return_counts=True)
            ids = batch.column("doc_id").take(pa.array((key >> 2 * HOT_BITS) + low))
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "pair": pa.array(key & (HOT * HOT - 1)), "n": pa.array(n, pa.int64())})


def _other_pairs(batches: Iterator[pa.RecordBatch], ranked) -> Iterator[pa.RecordBatch]:
    """(doc_id, first, second, n) of pairs with a word that has no rank."""
    for batch in batches:
        for row, *pair, head in _blocks(batch):
            first, second = (ranked.value.codes(h) for h in pair)
            take = ((first < 0) | (second < 0)) & ~head
            (row, first, second), n = _counted(row[take], first[take], second[take])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(pa.array(row)), "first": pa.array(first), "second": pa.array(second), "n": pa.array(n, pa.int64())}
            )


def _most_frequent(words: DataFrame, hot: int, dense: int) -> Ranked:
    """So many words come to the driver."""
    top = words.orderBy(F.desc("c_word"), "word").limit(hot).toArrow()
    h = np.asarray(top["word"]).astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Ranked(h[order], order.astype(np.int64), np.log(np.asarray(top["c_word"]).astype(float)), dense)


def score(docs: DataFrame, min_count: int = 2, backoff: float = 0.4, hot: int = HOT, dense: int = DENSE) -> DataFrame:
    """doc_id, n_words and score (natural logarithm) of ``docs`` (doc_id, text), counted in the same texts.

    ``hot`` (at most HOT) and ``dense`` decide only how the counts are found.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = texts.select("text").mapInArrow(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("c_word"))
    words = written_table(words, "lm-words")
    total = max(words.agg(F.coalesce(F.sum("c_word"), F.lit(0))).first()[0], 1)
    top = _most_frequent(words, hot, dense)
    ranked = spark.sparkContext.broadcast(top)
    odds = float(np.log(total) - np.log(backoff))  # what a known pair gains besides its counts

    cells = texts.select("text").mapInArrow(partial(_dense_counts, ranked=ranked), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = cells.where(F.col("n") >= min_count).toArrow()  # dense * dense rows at most
    cell = np.asarray(cells["cell"]).astype(np.int64)
    extra = np.zeros(dense * dense)
    extra[cell] = np.log(np.asarray(cells["n"]).astype(float)) - top.logs[cell // dense] - top.logs[cell % dense] + odds
    gains = spark.sparkContext.broadcast(extra)

    base = texts.mapInArrow(
        partial(_texts, ranked=ranked, gains=gains, total=total, backoff=backoff),
        "doc_id long, n_words long, score double, word array<long>, alone array<boolean>, times array<long>",
    )
    base = written_table(base, "lm-texts")
    coded = words.select(F.col("word").bitwiseOR(F.lit(_SIGN)).alias("code"), F.log("c_word").alias("log_word"))
    others = base.select("doc_id", F.explode(F.arrays_zip("word", "alone", "times")).alias("g")).select("doc_id", "g.*")
    share = F.col("log_word") - float(np.log(total)) + F.when(F.col("alone"), 0.0).otherwise(float(np.log(backoff)))
    others = others.join(coded, F.col("word") == F.col("code")).select("doc_id", (F.col("times") * share).alias("score"))

    logs = spark.createDataFrame(pa.table({"rank": np.arange(len(top.logs)), "log_word": top.logs}), "rank long, log_word double")
    of_first = F.broadcast(logs.withColumnsRenamed({"rank": "first", "log_word": "log_first"}))
    of_second = F.broadcast(logs.withColumnsRenamed({"rank": "second", "log_word": "log_second"}))

    def known(pairs: DataFrame, *key: str) -> DataFrame:
        counted = pairs.withColumn("c_pair", F.sum("n").over(Window.partitionBy(*key)))
        return counted.where(F.col("c_pair") >= min_count)

    pairs = known(texts.mapInArrow(partial(_ranked_pairs, ranked=ranked), "doc_id long, pair long, n long"), "pair")
    pairs = pairs.withColumns({"first": F.shiftright("pair", HOT_BITS), "second": F.col("pair").bitwiseAND(F.lit(HOT - 1))})
    rare = known(texts.mapInArrow(partial(_other_pairs, ranked=ranked), "doc_id long, first long, second long, n long"), "first", "second")
    rare = written_table(rare, "lm-known")
    gain = F.col("n") * (F.log("c_pair") + F.lit(odds) - F.coalesce("log_first", F.lit(0.0)) - F.coalesce("log_second", F.lit(0.0)))
    by_rank = [p.join(of_first, "first", "left").join(of_second, "second", "left").select("doc_id", gain.alias("score")) for p in (pairs, rare)]
    by_hash = rare.select("doc_id", "n", F.explode(F.array("first", "second")).alias("word")).where("word < 0")
    by_hash = by_hash.join(coded, F.col("word") == F.col("code")).select("doc_id", (-F.col("n") * F.col("log_word")).alias("score"))

    parts = base.select("doc_id", "n_words", "score")
    for more in (others, *by_rank, by_hash):
        summed = more.groupBy("doc_id").agg(F.sum("score").alias("score"))
        parts = parts.unionByName(summed.withColumn("n_words", F.lit(0).cast("long")))
    scored = parts.groupBy(F.col("doc_id").alias("scored_id")).agg(F.sum("n_words").alias("n_words"), F.sum("score").alias("score"))
    ids = texts.select("doc_id").distinct()
    return ids.join(scored, F.col("doc_id").eqNullSafe(F.col("scored_id")), "left").select(
        "doc_id", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
