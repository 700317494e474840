"""Toxicity of texts from labels of whole texts: multiple-instance learning over sentences.

A sentence's score is a logistic function of its hashed words; a text's score is a noisy-or of its
sentences over one background of the whole text, 1 - (1 - p0) * prod((1 - p) / (1 - p0)). Only sentences that
hold a word the model uses and score above the background take part, and sentences with the same such words
count once, so sentences that tell nothing and repeated ones don't add to a long text's score. The model is
fitted to text labels through that noisy-or, so it learns which sentences must be toxic for the labels to
hold, and then locates them in every text.

Training reads a bounded sample of labelled texts (``Settings.per_class`` texts of either label, chosen
by a hash of their ids, one text an id, and ``Settings.max_pairs`` word-in-sentence pairs at most, half of
them a label; a text that doesn't fit is passed over, not those behind it); class weights restore
the share of either label among all labelled rows. Scoring reads every whole text, map-side.

Sentences end at ``.``, ``!``, ``?`` or a line break; words are runs of ASCII letters, digits and
non-ASCII characters, in lower case for A-Z. Null and empty text has no sentence and scores 0. Labels that
are null or whose doc_id is null are ignored; where a doc_id has several labels the largest counts.
Without labels of both classes the share of toxic labels (0 without labels) is the score of every text
with words. Repeated rows are scored alike. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm import words as W
from reelframe.session import written_table

FEATURE_BITS = 38  # words of a long text hardly ever meet a used word's feature by chance; 25 bits number sentences
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """``per_class``, ``max_pairs``: bounds of the training sample.

    ``min_sentences``, ``min_z``: a word is used if so many different sentences of toxic texts hold it and
    its share among them is larger than among the other sentences by so many standard errors.
    """

    per_class: int = 6000
    max_pairs: int = 6_000_000
    min_sentences: int = 4
    min_z: float = 5.0
    rounds: int = 200
    rate: float = 0.15
    ridge: float = 1e-5
    start: float = -6.0


@dataclass(frozen=True)
class Model:
    """``features``: the used words, ascending, each with its weight; all others weigh nothing."""

    bias: float
    features: np.ndarray
    weights: np.ndarray

    def find(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of ``features``, and which of them are used."""
        if not len(self.features):
            return np.zeros(len(features), np.float32), np.zeros(len(features), bool)
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        used = self.features[at] == features
        return np.where(used, self.weights[at], np.float32(0)), used


def _tables() -> tuple[np.ndarray, np.ndarray]:
    separators = np.ones(256, bool)
    for a, z in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        separators[a:z] = False
    stops = np.zeros(256, bool)
    stops[[0x2E, 0x21, 0x3F, 0x0A]] = True
    return separators, stops


SEPARATORS, STOPS = _tables()


def sentence_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes, stop positions, feature of each word, sentence of each word)."""
    for row, data, hashes, starts in W.row_spans(texts, True, SEPARATORS):
        stops = np.flatnonzero(STOPS[data])
        yield row, data, stops, (hashes >> _U(64 - FEATURE_BITS)).astype(np.int64), np.searchsorted(stops, starts)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _training_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"pairs": [], "n": []}
        for _, _, _, features, sentences in sentence_words(batch.column("text")):
            pairs = np.unique((sentences << FEATURE_BITS) | features)
            out["pairs"].append(pairs)
            out["n"].append(len(pairs))
        yield pa.RecordBatch.from_pydict(
            {"rank": batch.column("rank"), "toxic": batch.column("toxic"), "n": pa.array(out["n"], pa.int64()), "pairs": pa.array(out["pairs"], pa.list_(pa.int64()))}
        )


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _telling(feature: np.ndarray, instance: np.ndarray, toxic: np.ndarray, s: Settings) -> np.ndarray:
    """Which rows hold a word to use. Equal sentences count once, so copies of one text don't make its words telling."""
    _, word = np.unique(feature, return_inverse=True)
    width = int(word.max()) + 1 if len(word) else 0
    content = np.zeros(len(toxic), np.uint64)
    np.add.at(content, instance, W.mix(feature.astype(np.uint64) + _U(1)))
    content = content * _U(2) + toxic
    _, once, same = np.unique(content, return_index=True, return_inverse=True)
    first_of = np.zeros(len(toxic), bool)
    first_of[once] = True
    kept = first_of[instance]
    a = np.bincount(word[kept & toxic[instance]], minlength=width)
    b = np.bincount(word[kept & ~toxic[instance]], minlength=width)
    n1, n0 = max(1, int((first_of & toxic).sum())), max(1, int((first_of & ~toxic).sum()))
    rate = (a + b) / (n1 + n0)
    z = (a / n1 - b / n0) / np.sqrt(rate * (1 - rate) * (1 / n1 + 1 / n0) + 1e-12)
    return ((a >= s.min_sentences) & (z >= s.min_z))[word]


def _once(owner: np.ndarray, instance: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Which (instance, feature) rows to keep so that equal feature sets of one owner count once; sorted by instance."""
    if not len(instance):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, instance[1:] != instance[:-1]))
    content = np.add.reduceat(W.mix(feature.astype(np.uint64) + _U(1)), starts)
    content = W.mix(content) + W.mix(owner[starts].astype(np.uint64) + _U(3))
    kept = np.zeros(len(starts), bool)
    kept[np.unique(content, return_index=True)[1]] = True
    return np.repeat(kept, np.diff(np.append(starts, len(instance))))


def fit(labels: np.ndarray, pairs: list[np.ndarray], positive_share: float, s: Settings) -> Model:
    """Bias and weights by full-batch Adam on the log loss of the noisy-or."""
    doc_of = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    flat = np.concatenate(pairs) if len(pairs) else np.zeros(0, np.int64)
    feature, sentence = flat & ((1 << FEATURE_BITS) - 1), flat >> FEATURE_BITS
    # Sentences keep an instance even when none of their words is used.
    key = (doc_of.astype(np.int64) << 40) | sentence
    _, first, instance = np.unique(key, return_index=True, return_inverse=True)
    owner = doc_of[first]
    used = _telling(feature, instance, labels.astype(bool)[owner], s)
    # Only sentences with used words, equal ones of a text once; the rest of a text is its background.
    order = np.flatnonzero(used)[np.argsort(instance[used], kind="stable")]
    order = order[_once(owner[instance[order]], instance[order], feature[order])]
    columns, compact = np.unique(feature[order], return_inverse=True)
    kept, rows = np.unique(instance[order], return_inverse=True)
    owner = owner[kept]
    y = labels.astype(bool)
    share = np.where(y, positive_share / max(1, y.sum()), (1 - positive_share) / max(1, (~y).sum()))
    w, b = np.zeros(len(columns)), s.start
    m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for t in range(1, s.rounds + 1):
        z = b + np.bincount(rows, weights=w[compact], minlength=len(owner))
        p, p0 = 1.0 / (1.0 + np.exp(-z)), 1.0 / (1.0 + np.exp(-b))
        above = z >= b
        total = _softplus(b) + np.bincount(owner, weights=np.where(above, _softplus(z) - _softplus(b), 0.0), minlength=len(labels))
        pull = np.where(y, -1.0 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) * share
        g = pull[owner] * np.where(above, p, 0.0)
        by_bias = p0 * pull.sum() + (g - pull[owner] * np.where(above, p0, 0.0)).sum()
        grad = np.append(np.bincount(compact, weights=g[rows], minlength=len(columns)) + s.ridge * w, by_bias)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return Model(float(b), columns, w.astype(np.float32))


def _fit_rows(batches: Iterator[pa.RecordBatch], positive_share: float, s: Settings) -> Iterator[pa.RecordBatch]:
    ranks, labels, pairs = [], [], []
    for batch in batches:
        ranks += batch.column("rank").to_pylist()
        labels += batch.column("toxic").to_pylist()
        pairs += [np.asarray(x.values) for x in batch.column("pairs")]
    order = np.lexsort((np.array([len(p) for p in pairs], int), np.array(ranks, np.int64), np.array(labels, int)))
    m = fit(np.array(labels)[order], [pairs[i] for i in order], positive_share, s)
    yield pa.RecordBatch.from_pydict({"bias": pa.array([m.bias]), "features": pa.array([m.features.astype(np.int64).tobytes()], pa.binary()), "weights": pa.array([m.weights.tobytes()], pa.binary())})


def _fitting(rank: np.ndarray, toxic: np.ndarray, n: np.ndarray, max_pairs: int) -> np.ndarray:
    """Ranks of the texts to train on: per label in order of rank what still fits half of the bound, the shortest at least."""
    chosen = []
    for label in (0, 1):
        mine = np.flatnonzero(toxic == label)
        mine, left, taken = mine[np.lexsort((n[mine], rank[mine]))], max_pairs // 2, []
        for i in mine:
            if n[i] <= left:
                left -= int(n[i])
                taken.append(rank[i])
        chosen += taken or [rank[mine[np.argmin(n[mine])]]] if len(mine) else []
    return np.array(chosen, np.int64)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); held-out ids are left out here."""
    s = settings or Settings()
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("t_doc"))
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("t_toxic"))
        .withColumn("t_rank", F.xxhash64("t_doc"))
    )
    # Labels of documents that aren't in this input can't be learned from.
    present = written_table(docs.select(F.col("doc_id").alias("d")).where("d IS NOT NULL").distinct().join(known, F.col("d") == F.col("t_doc")).drop("d"), "toxic-labels")
    counts = {r.t_toxic: r["count"] for r in present.groupBy("t_toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if not counts.get(1) or not counts.get(0):
        p = min(max(share, 0.0), 1.0)
        return Model(float(np.log(p / (1 - p))) if 0 < p < 1 else (50.0 if p else -50.0), np.zeros(0, np.int64), np.zeros(0, np.float32))
    chosen = None
    for label in (0, 1):
        part = present.where(F.col("t_toxic") == label).orderBy("t_rank", "t_doc").limit(s.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = written_table(chosen, "toxic-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("t_doc"))  # 2 * per_class rows
    rows = rows.groupBy(F.col("t_rank").alias("rank"), F.col("t_doc"), F.col("t_toxic").alias("toxic")).agg(F.min("text").alias("text"))
    pairs = written_table(
        rows.select("rank", "toxic", "text").mapInArrow(_training_pairs, "rank long, toxic int, n long, pairs array<long>"),
        "toxic-pairs",
    )
    # 2 * per_class lengths.
    rank, toxic, n = np.array([tuple(r) for r in pairs.select("rank", "toxic", "n").collect()], np.int64).reshape(-1, 3).T
    if n.sum() > s.max_pairs:
        within = docs.sparkSession.createDataFrame([(int(x),) for x in _fitting(rank, toxic, n, s.max_pairs)], "rank long")
        pairs = pairs.join(F.broadcast(within), "rank")
    row = pairs.coalesce(1).mapInArrow(partial(_fit_rows, positive_share=share, s=s), "bias double, features binary, weights binary").first()
    return Model(row.bias, np.frombuffer(row.features, np.int64), np.frombuffer(row.weights, np.float32))


def _text_scores(texts: pa.Array, model: Model) -> Iterator[tuple[int, float, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, score, bytes, sentence borders, sentence probabilities)."""
    for row, data, stops, features, sentences in sentence_words(texts):
        if not len(features):
            yield row, 0.0, data, stops, np.zeros(0)
            continue
        # A word counts once a sentence.
        pairs = np.unique((sentences << FEATURE_BITS) | features)
        s = pairs >> FEATURE_BITS
        f = pairs & ((1 << FEATURE_BITS) - 1)
        weights, used = model.find(f)
        z = np.bincount(s, weights=weights, minlength=len(stops) + 1) + model.bias
        z[np.bincount(s, minlength=len(z)) == 0] = -np.inf
        s, f = s[used], f[used]
        once = np.unique(s[_once(np.zeros(len(s), np.int64), s, f)])
        ground = _softplus(model.bias)
        total = ground + np.maximum(_softplus(z[once]) - ground, 0).sum()
        yield row, float(-np.expm1(-total)), data, stops, 1.0 / (1.0 + np.exp(-z))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        scores, found = np.zeros(batch.num_rows), [None] * batch.num_rows
        for row, score, data, stops, p in _text_scores(batch.column("text"), m):
            scores[row] = score
            bad = np.flatnonzero(p >= 0.5)
            if score >= 0.5 and not len(bad):
                bad = np.array([int(np.argmax(p))])
            if len(bad):
                # Character positions: bytes that begin a character.
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                edges = np.concatenate([[0], stops + 1, [len(data)]])
                found[row] = [{"start": int(chars[edges[i]]), "end": int(chars[edges[i + 1]]), "score": float(p[i])} for i in bad]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores), "sentences": pa.array(found, kind)})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, and the offending sentences (start and end in characters, probability; null if none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        partial(_score, model=shared), "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>"
    )


def _keep(batches: Iterator[pa.RecordBatch], model, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for row, value, *_ in _text_scores(batch.column("text"), model.value):
            keep[row] = value < threshold
        yield batch.filter(pa.array(keep))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, model=shared, threshold=threshold), docs.schema)
