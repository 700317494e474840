"""Near-duplicate texts by Jaccard similarity of their word n-grams, exactly, by prefix filtering.

1. Sketches count all words and all n-grams of all texts in 2^18 and 2^20 hashed cells (one array a task, summed in
   segments). They order n-grams from rare to frequent: by the product of the shares of their words, which tells rare
   ones apart however many there are, and by their own count where that stands out (passages that many texts
   share). The order decides only the speed; any order gives the same links.
2. Per text: set size, a 128-bit fingerprint of the set, its rarest n-grams (the prefix) and the parities
   of 512 hash ranges. Texts with equal sets form a class, and the class's smallest id stands for it.
3. Classes that share a prefix n-gram are candidates. The length filter, the positional filter and a
   suffix filter drop what can't reach the threshold: an n-gram in one set only flips one parity, so
   the number of differing parities is a lower bound of the difference of two sets. Parities of long texts differ
   too little for that; these texts also count their n-grams in 1,024 hash ranges, and the sum of the differences of
   these counts is such a bound, too. What is left is verified on the whole sets of both texts, once per pair.
   N-grams with the same list of classes give the same pairs, so one list stands for them.
4. In each list of classes with a common prefix n-gram, first only pairs with one hub (chosen by a seeded
   hash) are verified. Members that now share a component need no further test, since components are what
   is asked for. Further rounds take other hubs while each halves the pairs of different components; then all pairs that still
   join two components are verified. So a group of many near copies costs about one test a member, and no pair of
   different components goes untested.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z. A text with fewer than n words is one
n-gram; null or empty text has none, is linked with nothing and is its own component. Rows that repeat an
id count as one document. Rows without id are returned with a null component. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.llm import words as W
from reelframe.llm.graph import components
from reelframe.session import written_table

CELL_BITS = 20
WORD_BITS = 18
CELLS = (1 << CELL_BITS) + (1 << WORD_BITS)
SEGMENT_BITS = 12
PARITIES = [f"p{i}" for i in range(8)]
MAX_HUB_ROUNDS = 8
PRECEDING = 8
FILTER_BITS = 23
TALLIES = 1024
_U = np.uint64


def _text_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per row: its words, its set, and where each n-gram of the set stands first."""
    for row, words in W.row_word_hashes(batch.column("text"), lower=True):
        yield row, words, *np.unique(W.shingle_hashes(words, n), return_index=True)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - CELL_BITS)).astype(np.int64)


def _word_cells(hashes: np.ndarray) -> np.ndarray:
    """Cells of words lie behind those of n-grams."""
    return (1 << CELL_BITS) + (hashes >> _U(64 - WORD_BITS)).astype(np.int64)


def _count_cells(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.uint32)
    for batch in batches:
        held, size = [], 0
        for _, words, g, _ in _text_sets(batch, n):
            held += [_cells(g), _word_cells(words)]
            size += len(g) + len(words)
            if size > 1 << 20:
                counts += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
    yield from _segments(counts)


def _segments(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = counts.reshape(-1, 1 << SEGMENT_BITS)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_pydict(
        {"segment": pa.array(used, pa.int32()), "counts": pa.array([parts[i].tobytes() for i in used], pa.binary())}
    )


def _sum_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels (eighths of log2 of the count) of the segments in this partition; reads them one by one."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[segment] = sums.get(segment, 0) + np.frombuffer(raw, np.uint32).astype(np.uint64)
    rows = [(s, np.minimum(8 * np.log2(1.0 + c), 255).astype(np.uint8).tobytes()) for s, c in sums.items()]
    yield pa.RecordBatch.from_pydict(
        {"segment": pa.array([s for s, _ in rows], pa.int32()), "levels": pa.array([x for _, x in rows], pa.binary())}
    )


def frequency_levels(docs: DataFrame, n: int) -> bytes:
    """One byte per cell, 1.25 MB for any input: how frequent its n-grams or words are."""
    parts = CELLS >> SEGMENT_BITS
    counted = docs.select("text").mapInArrow(partial(_count_cells, n=n), "segment int, counts binary")
    levels = counted.repartition(min(parts, 64), "segment").mapInArrow(_sum_segments, "segment int, levels binary")
    table = np.zeros((parts, 1 << SEGMENT_BITS), np.uint8)
    for row in levels.collect():  # a byte a cell
        table[row.segment] = np.frombuffer(row.levels, np.uint8)
    return table.tobytes()


class _Order:
    """Keys of n-grams whose order is from rare to frequent, the same for every text."""

    RARITY_BITS = 12

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        counts = np.exp2(table / 8.0) - 1
        self.words = 8 * np.log2(max(counts[1 << CELL_BITS :].sum(), 1.0))
        #: A cell with four times the mean holds an n-gram that many texts share.
        self.frequent = 8 * np.log2(1 + 4 * counts[: 1 << CELL_BITS].mean())

    def keys(self, words: np.ndarray, g: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
        """Rarity in eighths of log2 of the count that the words' shares let expect, then the hash."""
        k = min(n, len(words))
        level = self.table[_word_cells(words)].astype(np.int64)
        expected = np.sum([level[first + j] for j in range(k)], axis=0) - int((k - 1) * self.words)
        counted = self.table[_cells(g)].astype(np.int64)
        rarity = np.where(counted > self.frequent, np.maximum(expected, counted), expected)
        half = 1 << (self.RARITY_BITS - 1)
        high = (np.clip(rarity, -half, half - 1) + half).astype(np.uint64)
        return (high << _U(64 - self.RARITY_BITS)) | (g & _U((1 << (64 - self.RARITY_BITS)) - 1))


def prefix_length(size: int, percent: int) -> int:
    """A text with this many n-grams shares at least one of so many with every text similar enough."""
    return size - (percent * size + 99) // 100 + 1


def _is_long(size: int, percent: int) -> bool:
    """Unrelated sets differ in about half of the parities, and the threshold allows nearly as much."""
    return 2 * (size - -(-2 * percent * size // (100 + percent))) > 24 * len(PARITIES)


def _tally(g: np.ndarray) -> bytes:
    """Counts of the n-grams in hash ranges, modulo 256."""
    cells = ((g >> _U(20)) & _U(TALLIES - 1)).astype(np.int64)
    return (np.bincount(cells, minlength=TALLIES) & 255).astype(np.uint8).tobytes()


def _describe(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels) -> Iterator[pa.RecordBatch]:
    order = _Order(np.frombuffer(levels.value, np.uint8))
    for batch in batches:
        ids = batch.column("doc_id")
        rows, sizes, f1, f2, prefixes, marks, tallies = [], [], [], [], [], [], []
        for row, words, g, first in _text_sets(batch, n):
            rows.append(row)
            sizes.append(len(g))
            f1.append(np.add.reduce(W.mix(g + _U(1))))
            f2.append(np.add.reduce(W.mix(g ^ _U(0x5851F42D4C957F2D))))
            keys = order.keys(words, g, first, n) if len(g) else g
            k = prefix_length(len(g), percent) if len(g) else 0
            if k < len(keys):
                keys = np.partition(keys, k - 1)[:k]
            prefixes.append(np.sort(keys).view(np.int64))
            odd = np.bincount((g & _U(64 * len(PARITIES) - 1)).astype(np.int64), minlength=64 * len(PARITIES)) & 1
            marks.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            tallies.append(_tally(g) if _is_long(len(g), percent) else None)
            if len(rows) >= 2000:
                yield _described(ids, rows, sizes, f1, f2, prefixes, marks, tallies)
                rows, sizes, f1, f2, prefixes, marks, tallies = [], [], [], [], [], [], []
        if rows:
            yield _described(ids, rows, sizes, f1, f2, prefixes, marks, tallies)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


def _described(ids, rows, sizes, f1, f2, prefixes, marks, tallies) -> pa.RecordBatch:
    table = np.stack(marks)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": ids.take(pa.array(rows)),
            "size": pa.array(sizes, pa.int64()),
            "f1": pa.array(np.array(f1, np.uint64).view(np.int64)),
            "f2": pa.array(np.array(f2, np.uint64).view(np.int64)),
            "prefix": _lists(prefixes, pa.int64()),
            "tally": pa.array(tallies, pa.binary()),
        }
        | {c: pa.array(np.ascontiguousarray(table[:, i])) for i, c in enumerate(PARITIES)}
    )


def _alpha(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of two sets that reach the threshold: 100 * o >= percent * (a + b - o)."""
    return F.ceil((percent * (a + b)) / (100 + percent)).cast("bigint")


def _could_reach(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Length filter, and positional filter: what can still be shared after the common n-gram."""
    lengths = (100 * F.least(nx, ny)) >= (percent * F.greatest(nx, ny))
    most = F.least(px, py) + 1 + F.least(nx - px, ny - py) - 1
    return lengths & (most >= _alpha(nx, ny, percent))


def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = _CachedSets(batch, "text_a", n)
        right = _CachedSets(batch, "text_b", n)
        linked = []
        for i in range(batch.num_rows):
            x, y = left[i], right[i]
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(linked, pa.bool_())})


class _CachedSets:
    """Sets of one text column of a batch; neighbouring rows with the same id share theirs."""

    def __init__(self, batch: pa.RecordBatch, column: str, n: int) -> None:
        self.texts, self.n, self.last = batch.column(column), n, (None, None)

    def __getitem__(self, i: int) -> np.ndarray:
        text = self.texts[i]
        if self.last[0] is None or not self.last[0].equals(text):
            _, words = next(W.row_word_hashes(self.texts.slice(i, 1), lower=True))
            self.last = (text, np.unique(W.shingle_hashes(words, self.n)))
        return self.last[1]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        bits[_filter_cells(np.asarray(batch.column(0)))] = True
    yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _filter_cells(ids: np.ndarray) -> np.ndarray:
    return (W.mix(ids.astype(np.int64).view(np.uint64)) >> _U(64 - FILTER_BITS)).astype(np.int64)


def _maybe(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    table = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
    for batch in batches:
        ids = batch.column("doc_id")
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        named[named] = table[_filter_cells(np.asarray(ids.drop_null()))]
        yield batch.filter(pa.array(named))


def _texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``pairs`` and few others.

    A bitmap of 2^FILTER_BITS hashed ids (1 MB for any input, 16 of them come to the driver) keeps most other
    texts out of the shuffle; the joins that follow are exact.
    """
    ids = pairs.select("a").union(pairs.select("b"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for row in ids.repartition(16).mapInArrow(_marked, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    return docs.select("doc_id", "text").mapInArrow(partial(_maybe, bits=shared), "doc_id long, text string").withColumnRenamed("doc_id", "id")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, linked) for candidate pairs of ids, on the whole texts of ``docs`` (doc_id, text).

    Only texts of candidates move: once to their pairs as ``b``, once more to the other side. Hot hubs
    are sides ``a`` of joins that Spark can split.
    """
    texts = _texts_of(pairs, docs)
    at_b = pairs.hint("merge").join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    both = at_b.hint("merge").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    found = both.select("a", "b", "text_a", "text_b").mapInArrow(partial(_verify, n=n, percent=percent), "a long, b long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("linked").alias("linked"))


def linked_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) per row of ``docs``.

    ``docs`` has doc_id (integer) and text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = spark.sparkContext.broadcast(frequency_levels(docs, n))
    described = written_table(
        docs.mapInArrow(
            partial(_describe, n=n, percent=percent, levels=levels),
            "doc_id long, size long, f1 long, f2 long, prefix array<long>, tally binary, " + ", ".join(f"{c} long" for c in PARITIES),
        ),
        "ngram-sets",
    )
    named = described.where("doc_id IS NOT NULL AND size > 0")
    classes = written_table(named.groupBy("f1", "f2", "size").agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    members = written_table(
        named.select("doc_id", "f1", "f2", "size").join(classes, ["f1", "f2", "size"]).select("doc_id", "class_id").distinct(), "ngram-members"
    )
    stands = (
        named.join(classes.select(F.col("class_id").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"])
        .groupBy("doc_id", "f1", "f2")
        .agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("tally").alias("tally"), *(F.first(c).alias(c) for c in PARITIES))
    )
    stands = written_table(stands, "ngram-stands")
    entries = stands.select("doc_id", "size", F.posexplode("prefix").alias("pos", "gram"))
    # Lists of one member link nothing.
    shared = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = _distinct_lists(written_table(entries.join(shared, "gram").select("gram", "doc_id", "size", "pos"), "ngram-shared"))
    # An id that repeats with other texts is in several classes and links them.
    homes = members.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")
    links = written_table(members.join(homes, "doc_id").where("a <> class_id").select("a", F.col("class_id").alias("b")), "ngram-links")
    tested = written_table(links.select("a", "b").limit(0), "ngram-tested")
    # An id that repeats with other texts has no single set to judge by: ``texts`` > 1 turns the filter off.
    facts = stands.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), *(F.first(c).alias(c) for c in PARITIES))
    tallies = stands.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.first("size").alias("size"), F.first("tally").alias("tally"))
    tallies = written_table(tallies.where("texts = 1 AND tally IS NOT NULL").drop("texts"), "ngram-tallies")
    roots = None
    open_lists, before = lists.withColumn("root", F.col("doc_id")), None
    for round_ in range(MAX_HUB_ROUNDS + 1):
        if roots is not None:
            rooted = lists.join(roots, F.col("doc_id") == F.col("node"), "left").select(
                "gram", "doc_id", "size", "pos", F.coalesce("component", "doc_id").alias("root")
            )
            mixed = rooted.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            open_lists = written_table(rooted.join(mixed.select("gram"), "gram"), "ngram-open")
        rows, pairs = _open_pairs(open_lists)
        if not rows:
            break
        last = round_ == MAX_HUB_ROUNDS or pairs <= 2 * rows or (before is not None and pairs > before / 2)
        before = pairs
        candidates = _all_pairs(open_lists, facts, percent) if last else _hub_pairs(open_lists, percent, round_)
        if not last:
            candidates = _suffix_filtered(candidates, facts, percent)
        # Written first, or the optimizer would look up each pair once for every n-gram that it shares.
        candidates = written_table(candidates, "ngram-pairs").join(tested, ["a", "b"], "left_anti")
        candidates = _tally_filtered(candidates, tallies, percent)
        found = written_table(verified(written_table(candidates, "ngram-candidates"), docs, n, percent), "ngram-verified")
        links = written_table(links.unionByName(found.where("linked").select("a", "b")), "ngram-links")
        roots = written_table(components(links), "ngram-roots")
        if last:
            break
        tested = written_table(tested.unionByName(found.select("a", "b")), "ngram-tested")
    if roots is None:
        roots = written_table(components(links), "ngram-roots")
    homes = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    of = homes.join(roots, F.col("class_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "class_id").alias("component_id"))
    return (
        described.select("doc_id", F.col("size").alias("n_shingles"))
        .join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _distinct_lists(lists: DataFrame) -> DataFrame:
    """One list, that of the rarest, for all n-grams with the same members.

    The filters drop no similar pair at any n-gram that it shares.
    """
    h = F.xxhash64("doc_id", "size")
    of = lists.groupBy("gram").agg(
        F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h1"), F.sum(F.shiftrightunsigned(h, 32)).alias("h2"),
    )
    # Keys rise as unsigned numbers.
    kept = of.groupBy("m", "low", "high", "h1", "h2").agg(F.min_by("gram", F.col("gram").bitwiseXOR(F.lit(-(1 << 63)))).alias("gram")).select("gram")
    return written_table(lists.join(kept, "gram", "left_semi"), "ngram-lists")


def _open_pairs(lists: DataFrame) -> tuple[int, int]:
    """Rows of the lists, and their pairs of different components."""
    c, m = F.col("c"), F.col("m")
    of = lists.groupBy("gram", "root").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("gram").agg(F.sum("c").alias("m"), F.sum(c * c).alias("same"))
    return of.agg(F.coalesce(F.sum("m"), F.lit(0.0)), F.coalesce(F.sum((m * m - F.col("same")) / 2), F.lit(0.0))).first()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _hub_pairs(lists: DataFrame, percent: int, seed: int) -> DataFrame:
    """Each list's members with its hub, where they are of different components and could be similar."""
    hub = F.min(F.struct(F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("size"), F.col("pos"), F.col("root")))
    hubs = lists.groupBy("gram").agg(hub.alias("hub")).select("gram", F.col("hub.doc_id").alias("x"), F.col("hub.size").alias("nx"), F.col("hub.pos").alias("px"), F.col("hub.root").alias("rx"))
    joined = lists.join(hubs, "gram")
    fits = (F.col("root") != F.col("rx")) & _could_reach(F.col("nx"), F.col("px"), F.col("size"), F.col("pos"), percent)
    return _ordered(joined.where(fits).select("x", F.col("doc_id").alias("y")))


def _near_enough(nx: Column, ny: Column, x: list[Column], y: list[Column], tx: Column, ty: Column, percent: int) -> Column:
    """Suffix filter: the differing parities against the largest difference that the threshold allows."""
    apart = F.lit(0)
    for u, v in zip(x, y, strict=True):
        apart = apart + F.bit_count(u.bitwiseXOR(v))
    return (tx > 1) | (ty > 1) | (apart <= nx + ny - 2 * _alpha(nx, ny, percent))


def _all_pairs(lists: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Every pair of a list that joins two components and could be similar.

    A pair shares many n-grams. It is made at those only that no other shared one shortly precedes in both prefixes:
    the list of that one holds the pair, too, and comes first in the order, so each pair is made at least once.
    """
    facts = facts.join(lists.select("doc_id").distinct(), "doc_id", "left_semi").drop("size")
    before = F.when(F.col("texts") == 1, F.slice("prefix", F.greatest(F.lit(1), F.col("pos") + 1 - PRECEDING), F.least(F.lit(PRECEDING), F.col("pos"))))
    lists = written_table(lists.join(facts, "doc_id").withColumn("before", before).drop("prefix"), "ngram-described")
    other = lists.select(
        "gram", F.col("doc_id").alias("x"), F.col("size").alias("nx"), F.col("pos").alias("px"), F.col("root").alias("rx"), F.col("texts").alias("tx"), F.col("before").alias("bx"), *(F.col(c).alias(f"x{c}") for c in PARITIES)
    )
    fits = (F.col("root") < F.col("rx")) & _could_reach(F.col("nx"), F.col("px"), F.col("size"), F.col("pos"), percent)
    near = _near_enough(F.col("nx"), F.col("size"), [F.col(f"x{c}") for c in PARITIES], [F.col(c) for c in PARITIES], F.col("tx"), F.col("texts"), percent)
    first = ~F.coalesce(F.arrays_overlap("before", "bx"), F.lit(False))
    mine = lists.alias("mine")
    other = other.withColumnRenamed("gram", "x_gram")
    return _ordered(mine.join(other, (F.col("gram") == F.col("x_gram")) & fits & near & first).select("x", F.col("doc_id").alias("y")))


def _suffix_filtered(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sets must differ too much by their parities."""
    x = facts.select(F.col("doc_id").alias("a"), F.col("texts").alias("ta"), F.col("size").alias("na"), *(F.col(c).alias(f"a{c}") for c in PARITIES))
    y = facts.select(F.col("doc_id").alias("b"), F.col("texts").alias("tb"), F.col("size").alias("nb"), *(F.col(c).alias(f"b{c}") for c in PARITIES))
    near = _near_enough(F.col("na"), F.col("nb"), [F.col(f"a{c}") for c in PARITIES], [F.col(f"b{c}") for c in PARITIES], F.col("ta"), F.col("tb"), percent)
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b")


def _tallied(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = np.ones(batch.num_rows, bool)
        both = np.flatnonzero((batch.column("ta").is_valid().to_numpy(False)) & (batch.column("tb").is_valid().to_numpy(False)))
        for rows in np.array_split(both, len(both) // 1024 + 1):
            if len(rows):
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint8).reshape(-1, TALLIES) for c in ("ta", "tb"))
                # On a ring of 256, a distance never exceeds that of the whole counts.
                apart = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64)
                size = batch.column("na").to_numpy(False)[rows].astype(np.int64) + batch.column("nb").to_numpy(False)[rows].astype(np.int64)
                near[rows] = apart <= size - 2 * -(-percent * size // (100 + percent))
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _tally_filtered(pairs: DataFrame, tallies: DataFrame, percent: int) -> DataFrame:
    """Drop pairs of long texts whose sets must differ too much by their counts in hash ranges."""
    x = tallies.select(F.col("doc_id").alias("a"), F.col("size").alias("na"), F.col("tally").alias("ta"))
    y = tallies.select(F.col("doc_id").alias("b"), F.col("size").alias("nb"), F.col("tally").alias("tb"))
    both = pairs.join(x, "a", "left").join(y, "b", "left").select("a", "b", "na", "nb", "ta", "tb")
    return both.mapInArrow(partial(_tallied, percent=percent), "a long, b long")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows without id stay."""
    grouped = linked_components(docs, n, percent)
    drop = written_table(grouped.where("component_id <> doc_id").select(F.col("doc_id").alias("ngram_drop")).distinct(), "ngram-drop")
    return docs.join(drop.hint("merge"), docs["doc_id"] == drop["ngram_drop"], "left_anti")
