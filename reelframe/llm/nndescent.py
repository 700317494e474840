"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily.

Building. Vectors are centred and cut to 8 bits with a scale each. A start comes from exact neighbours
inside random groups of ``group_size`` at most, a quarter of a small table; only ``k`` vectors or fewer are
compared all with all instead. Each round compares, for every node, a sample of its neighbours and
of the nodes that name it, where at least one is new (a join of neighbours of neighbours), and keeps the
``k`` nearest. Samples per node are bounded by a ranked window, which Spark limits before the shuffle, so a
node that very many others name costs no more than the rest. Rounds end when few lists change.

Searching. A query keeps a pool of its ``beam`` nearest vectors met so far. Each hop takes the nearest
ones not yet expanded, joins the graph for their neighbours, computes distances to those not met before, and
goes on until the pool holds nothing to expand. It starts from a sample of ``entries`` ids and from its own
neighbours where it is in the graph. The nearest of the pool are measured again on the original vectors in
double precision. All steps are joins over all queries at once; nothing is collected but counts.

Vectors that are null, empty, zero, of another length than most, or that hold a null or non-finite
component take no part, nor do rows without id. Rows that repeat an id count once (the smallest vector).
Equal distances go to the smaller id. With fewer candidates than asked for, all are returned.
Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.words import mix
from reelframe.session import written_table

_U = np.uint64


@dataclass(frozen=True)
class Graph:
    """``k``: list length. ``sample``: new and old neighbours compared a node and direction. ``best``: finds kept a member."""

    k: int = 24
    sample: int = 16
    best: int = 5
    rounds: int = 6
    enough: float = 0.002
    group_size: int = 2048
    groupings: int = 3
    reverse: int = 48
    beam: int = 480
    step: int = 96
    entries: int = 64


def clean_vectors(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec (array of doubles) of the rows that take part."""
    v = F.col("vec")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where("vec_id IS NOT NULL AND vec IS NOT NULL").where(~F.coalesce(odd, F.lit(True))).where(F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select(F.col("n").alias("common_n"))
    rows = rows.join(F.broadcast(common), F.size("vec") == F.col("common_n")).drop("common_n")
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _small_form(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    width = len(centre)
    for batch in batches:
        x = np.asarray(batch.column("vec").flatten(), np.float64).reshape(-1, width)
        c = x - centre
        scale = np.maximum(np.abs(c).max(axis=1), 1e-300) / 127
        q = np.rint(c / scale[:, None]).astype(np.int8)
        square = (q.astype(np.float64) ** 2).sum(axis=1) * scale**2
        yield pa.RecordBatch.from_pydict(
            {
                "vec_id": batch.column("vec_id"),
                "full": pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()),
                "small": pa.array([r.tobytes() for r in q], pa.binary()),
                "scale": pa.array(scale),
                "square": pa.array(square),
            }
        )


def _distances(q: np.ndarray, scale: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Squared distances inside groups (groups, members, width); equal in whatever group a pair meets."""
    exact = np.float32 if q.shape[-1] <= 1000 else np.float64  # products of 8-bit values stay whole numbers
    x = q.astype(exact)
    dots = np.matmul(x, np.swapaxes(x, -1, -2)).astype(np.float64)
    return square[..., :, None] + square[..., None, :] - 2 * (scale[..., :, None] * scale[..., None, :]) * dots


def _start_group(table: pa.Table, width: int, k: int) -> pa.Table:
    """Exact neighbours inside one random group."""
    ids = np.asarray(table.column("vec_id"))
    q = _matrix(table.column("small").combine_chunks(), "i1", width)
    d = _distances(q, np.asarray(table.column("scale")), np.asarray(table.column("square")))
    np.fill_diagonal(d, np.inf)
    most = min(k, len(ids) - 1)
    if most < 1:
        near = np.zeros((len(ids), 0), np.int64)
    else:
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
    gaps = np.take_along_axis(d, near, 1)
    return pa.table(
        {
            "node": pa.array(ids, pa.int64()),
            "ids": pa.array(list(ids[near]), pa.list_(pa.int64())),
            "gaps": pa.array(list(gaps), pa.list_(pa.float64())),
        }
    )


def _merge(batches: Iterator[pa.RecordBatch], k: int, round_: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Best ``k`` of each node's list and its finds; finds are new, and listed ones stay new until sampled."""
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        out: dict[str, list] = {"ids": [], "gaps": [], "new": []}
        changed = []
        for i, node in enumerate(columns["node"]):
            ids, gaps, new = columns["ids"][i] or [], columns["gaps"][i] or [], columns["new"][i] or []
            if ids and round_ >= 0:
                used = set(_sampled(node, ids, new, True, round_, sample))
                new = [n and j not in used for j, n in zip(ids, new)]
            known = set(ids)
            found = {j: g for j, g in zip(columns["found_ids"][i] or [], columns["found_gaps"][i] or []) if j not in known and j != node}
            best = sorted([*zip(gaps, ids, new), *((g, j, True) for j, g in found.items())])[:k]
            out["ids"].append([b[1] for b in best])
            out["gaps"].append([b[0] for b in best])
            out["new"].append([b[2] for b in best])
            changed.append(sum(1 for b in best if b[1] in found))
        yield pa.RecordBatch.from_pydict(
            {
                "node": batch.column("node"),
                "ids": pa.array(out["ids"], pa.list_(pa.int64())),
                "gaps": pa.array(out["gaps"], pa.list_(pa.float64())),
                "new": pa.array(out["new"], pa.list_(pa.bool_())),
                "changed": pa.array(changed, pa.int64()),
            }
        )


def _dice(a: int, b: np.ndarray, round_: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(mix(b.astype(np.int64).view(np.uint64) + _U(1)) ^ mix(np.array([a], np.int64).view(np.uint64) + _U(7919 * (round_ + 1))))


def _sampled(node: int, ids: list, new: list, want: bool, round_: int, sample: int) -> list:
    """The seeded sample of a list's new or old members."""
    mine = np.array([j for j, n in zip(ids, new) if n == want], np.int64)
    return mine[np.argsort(_dice(node, mine, round_), kind="stable")[:sample]].tolist()


def _edges(batches: Iterator[pa.RecordBatch], round_: int, sample: int) -> Iterator[pa.RecordBatch]:
    """Who is compared at whom: sampled members at the node, and the node at its sampled members."""
    for batch in batches:
        at, member, fresh = [], [], []
        for node, ids, new in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), batch.column("new").to_pylist(), strict=True):
            for want in (True, False):
                for j in _sampled(node, ids, new, want, round_, sample):
                    at += [node, j]
                    member += [j, node]
                    fresh += [want, want]
        a, m = np.array(at, np.int64), np.array(member, np.int64)
        forward = np.arange(len(a)) % 2 == 0
        with np.errstate(over="ignore"):
            dice = mix(mix(a.view(np.uint64)) + m.view(np.uint64) + _U(round_)) >> _U(1)
        yield pa.RecordBatch.from_pydict(
            {"at": pa.array(a), "member": pa.array(m), "fresh": pa.array(fresh, pa.bool_()), "forward": pa.array(forward), "dice": pa.array(dice.view(np.int64))}
        )


def _compare(batches: Iterator[pa.RecordBatch], width: int, best: int, most: int) -> Iterator[pa.RecordBatch]:
    """Finds (node, other, gap) of all nodes' samples; batches come sorted by ``at``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        at = np.asarray(table.column("at"))
        if not len(at):
            continue
        cut = int(np.searchsorted(at, at[-1]))  # the last node may go on in the next batch
        held = table.slice(cut).combine_chunks()
        if cut:
            yield from _compare_nodes(table.slice(0, cut).combine_chunks(), width, best, most)
    if held is not None and held.num_rows:
        yield from _compare_nodes(held, width, best, most)


def _compare_nodes(table: pa.Table, width: int, best: int, most: int) -> Iterator[pa.RecordBatch]:
    col = {c: np.asarray(table.column(c)) for c in ("at", "member", "fresh", "scale", "square", "limit")}
    q_all = _matrix(table.column("small").combine_chunks(), "i1", width)
    # A member named twice counts once, as new if it is new in either place.
    order = np.lexsort((~col["fresh"], col["member"], col["at"]))
    first = np.ones(len(order), bool)
    a, m = col["at"][order], col["member"][order]
    first[1:] = (a[1:] != a[:-1]) | (m[1:] != m[:-1])
    order = order[first]
    a = col["at"][order]
    starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    sizes = np.diff(np.append(starts, len(a)))
    step = max(1, (1 << 21) // (most * most))
    for s in range(0, len(starts), step):
        n = sizes[s : s + step]
        top = int(n.max())
        at = np.minimum(starts[s : s + step, None] + np.arange(top), len(order) - 1)
        real = np.arange(top) < n[:, None]
        rows = order[at]
        d = _distances(q_all[rows], col["scale"][rows], col["square"][rows])
        fresh = col["fresh"][rows] & real
        ok = (fresh[:, :, None] | fresh[:, None, :]) & real[:, :, None] & real[:, None, :]
        ok[:, np.arange(top), np.arange(top)] = False
        d = np.where(ok & (d < col["limit"][rows][:, :, None]), d, np.inf)
        k = min(best, top)
        near = np.argpartition(d, k - 1, axis=2)[:, :, :k]
        gap = np.take_along_axis(d, near, 2)
        g, i, j = np.nonzero(np.isfinite(gap))
        node = col["member"][rows[g, i]]
        other = col["member"][rows[g, near[g, i, j]]]
        yield pa.RecordBatch.from_pydict({"node": pa.array(node), "other": pa.array(other), "gap": pa.array(gap[g, i, j])})


def build(vectors: DataFrame, g: Graph) -> tuple[DataFrame, DataFrame]:
    """(lists, small forms) for vec_id and vec; lists has node, ids and gaps, nearest first."""
    n = vectors.count()
    width = len(vectors.select("vec").first().vec) if n else 0
    means = vectors.select([F.avg(F.get("vec", F.lit(i))).alias(str(i)) for i in range(width)]).first() if n else []
    forms = written_table(
        vectors.mapInArrow(partial(_small_form, centre=np.array(list(means))), "vec_id long, full binary, small binary, scale double, square double"), "ann-forms"
    )
    # A small table is dealt as well, so its rounds run like those of a large one.
    groups = 1 if n <= g.k else max(2, -(-n // min(g.group_size, max(2 * g.k, n // 4))))
    seeds = F.explode(F.array(*(F.lit(i) for i in range(g.groupings if groups > 1 else 1))))
    dealt = forms.select("vec_id", "small", "scale", "square", seeds.alias("deal")).withColumn("group", F.pmod(F.xxhash64("vec_id", "deal"), F.lit(groups)))
    k0 = g.k if groups == 1 else g.k // g.groupings + 6
    started = dealt.groupBy("deal", "group").applyInArrow(lambda t: _start_group(t, width, k0), "node long, ids array<long>, gaps array<double>")
    start = started.groupBy("node").agg(F.flatten(F.collect_list("ids")).alias("found_ids"), F.flatten(F.collect_list("gaps")).alias("found_gaps"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("gaps", "array<double>"), ("new", "array<boolean>"))]
    kind = "node long, ids array<long>, gaps array<double>, new array<boolean>, changed long"
    lists = written_table(start.select("node", *empty, "found_ids", "found_gaps").mapInArrow(partial(_merge, k=g.k, round_=-1, sample=g.sample), kind), "ann-lists")
    if groups == 1:  # the one group has compared all with all
        return lists, forms
    for round_ in range(g.rounds):
        edges = lists.select("node", "ids", "new").mapInArrow(partial(_edges, round_=round_, sample=g.sample), "at long, member long, fresh boolean, forward boolean, dice long")
        ranked = F.row_number().over(Window.partitionBy("at", "fresh", "forward").orderBy("dice", "member"))
        edges = edges.withColumn("turn", ranked).where(F.col("turn") <= g.sample).select("at", "member", "fresh")
        limit = F.when(F.size("gaps") >= g.k, F.element_at("gaps", -1)).otherwise(F.lit(float("inf")))
        members = forms.select("vec_id", "small", "scale", "square").join(lists.select("node", limit.alias("limit")), F.col("vec_id") == F.col("node")).drop("node")
        rows = edges.join(members, F.col("member") == F.col("vec_id")).drop("vec_id")
        parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        finds = rows.repartition(parts, "at").sortWithinPartitions("at").mapInArrow(
            partial(_compare, width=width, best=g.best, most=4 * g.sample), "node long, other long, gap double"
        )
        turn = F.row_number().over(Window.partitionBy("node").orderBy("gap", "other"))
        finds = finds.distinct().withColumn("turn", turn).where(F.col("turn") <= 2 * g.k)
        finds = finds.groupBy("node").agg(F.collect_list("other").alias("found_ids"), F.collect_list("gap").alias("found_gaps"))
        merged = lists.drop("changed").join(finds, "node", "left").select("node", "ids", "gaps", "new", "found_ids", "found_gaps")
        lists = written_table(merged.mapInArrow(partial(_merge, k=g.k, round_=round_, sample=g.sample), kind), "ann-lists")
        if (lists.agg(F.sum("changed")).first()[0] or 0) < g.enough * n * g.k:
            break
    return lists, forms


def adjacency(lists: DataFrame, g: Graph) -> DataFrame:
    """node and neighbours: its list and the nearest ``reverse`` nodes that name it."""
    links = lists.select(F.col("node"), F.explode(F.arrays_zip("ids", "gaps")).alias("x")).select("node", F.col("x.ids").alias("other"), F.col("x.gaps").alias("gap"))
    turn = F.row_number().over(Window.partitionBy("other").orderBy("gap", "node"))
    back = links.withColumn("turn", turn).where(F.col("turn") <= g.reverse).select(F.col("other").alias("node"), F.col("node").alias("other"))
    return written_table(links.select("node", "other").unionByName(back).groupBy("node").agg(F.collect_set("other").alias("near")), "ann-graph")


def _pair_distances(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (_matrix(batch.column(c), "<f4", width).astype(np.float64) for c in ("asked", "full"))
        yield pa.RecordBatch.from_pydict({"query": batch.column("query"), "id": batch.column("id"), "gap": pa.array(((x - y) ** 2).sum(axis=1))})


def _advance(batches: Iterator[pa.RecordBatch], beam: int, step: int) -> Iterator[pa.RecordBatch]:
    """Pools with the distances of this hop; ``next`` are the nearest not yet expanded."""
    for batch in batches:
        rows = {c: batch.column(c).to_pylist() for c in ("pool", "pool_gaps", "done", "seen", "got", "got_gaps")}
        out: dict[str, list] = {"pool": [], "pool_gaps": [], "done": [], "seen": [], "next": []}
        for pool, gaps, done, seen, got, got_gaps in zip(*rows.values(), strict=True):
            ids = np.array((pool or []) + (got or []), np.int64)
            d = np.array((gaps or []) + (got_gaps or []), np.float64)
            old = np.isin(ids, np.array(done or [], np.int64))
            order = np.lexsort((ids, d))[:beam]
            ids, d, old = ids[order], d[order], old[order]
            ahead = ids[~old][:step]
            out["pool"].append(ids)
            out["pool_gaps"].append(d)
            out["done"].append(np.concatenate([ids[old], ahead]))
            out["seen"].append(np.array((seen or []) + (got or []), np.int64))
            out["next"].append(ahead)
        yield pa.RecordBatch.from_pydict(
            {"query": batch.column("query"), **{c: pa.array(v, pa.list_(pa.float64() if c == "pool_gaps" else pa.int64())) for c, v in out.items()}}
        )


def search(queries: DataFrame, lists: DataFrame, forms: DataFrame, g: Graph, max_hops: int = 200) -> DataFrame:
    """query, id and gap (squared distance in single precision) of each query's pool.

    ``queries`` has query and asked (a vector as little-endian single floats); a query whose id is in the
    graph is not its own neighbour.
    """
    spark = queries.sparkSession
    graph = adjacency(lists, g)
    first = forms.select("full").first()
    width = len(first.full) // 4 if first else 0
    entries = [r.vec_id for r in forms.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(g.entries).collect()]
    asked = written_table(queries.select("query", "asked"), "ann-asked")
    begin = F.array_distinct(F.concat(F.array(*(F.lit(e) for e in entries)).cast("array<long>"), F.coalesce("near", F.array().cast("array<long>"))))
    fresh = asked.join(graph, F.col("query") == F.col("node"), "left").select("query", F.array_except(begin, F.array("query")).alias("fresh"))
    nothing = {c: F.array().cast("array<double>" if c == "pool_gaps" else "array<long>") for c in ("pool", "pool_gaps", "done")}
    state = asked.select("query").withColumns(nothing).withColumn("seen", F.array("query"))
    kind = "query long, pool array<long>, pool_gaps array<double>, done array<long>, seen array<long>, next array<long>"
    for _ in range(max_hops):
        pairs = fresh.select("query", F.explode("fresh").alias("id")).join(forms.select(F.col("vec_id").alias("id"), "full"), "id").join(asked, "query")
        measured = pairs.select("query", "id", "asked", "full").mapInArrow(partial(_pair_distances, width=width), "query long, id long, gap double")
        got = measured.groupBy("query").agg(F.collect_list(F.struct("id", "gap")).alias("x")).select("query", F.col("x.id").alias("got"), F.col("x.gap").alias("got_gaps"))
        state = written_table(
            state.drop("next").join(got, "query", "left").select("query", "pool", "pool_gaps", "done", "seen", "got", "got_gaps").mapInArrow(
                partial(_advance, beam=g.beam, step=g.step), kind
            ),
            "ann-state",
        )
        ahead = state.select("query", F.explode("next").alias("at"))
        if ahead.isEmpty():
            break
        near = ahead.join(graph, F.col("at") == F.col("node")).groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        fresh = near.join(state.select("query", "seen"), "query").select("query", F.array_except("near", "seen").alias("fresh"))
    return state.select("query", F.explode(F.arrays_zip("pool", "pool_gaps")).alias("x")).select("query", F.col("x.pool").alias("id"), F.col("x.pool_gaps").alias("gap"))


def nearest(table: DataFrame, query_ids: DataFrame, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", settings: Graph | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the ``k`` nearest found for each id of ``query_ids`` (query_id)."""
    g = settings or Graph()
    vectors = written_table(clean_vectors(table, id_column, vector), "ann-vectors")
    lists, forms = build(vectors, g)
    wanted = forms.join(query_ids.select(F.col("query_id").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query"), F.col("full").alias("asked"))
    found = search(wanted, lists, forms, g)
    turn = F.row_number().over(Window.partitionBy("query").orderBy("gap", "id"))
    close = found.withColumn("turn", turn).where(F.col("turn") <= 4 * k).select("query", "id")
    exact = (
        close.join(vectors.select(F.col("vec_id").alias("id"), F.col("vec").alias("y")), "id")
        .join(vectors.select(F.col("vec_id").alias("query"), F.col("vec").alias("x")), "query")
        .withColumn("score", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")
