"""Token counts of documents in flat token files: a scan for the end-of-document id, stitched by prefix sums.

A file is a stream of fixed-width little-endian ids without any index. It is read in blocks that cut
documents anywhere. Each block is searched at once with NumPy and gives the places of its separators. What
stands before a block (separators, ids, and ids since the last separator) comes from a prefix scan over
block summaries in two levels: inside chunks of ``CHUNK`` blocks, then over the chunks of a file. So
a file of any length is scanned by many tasks.

Memory doesn't grow with the files, nor with the number of documents in a block. Blocks are written in row groups of about
``GROUP_BYTES``, since Spark reads up to 4,096 rows of a group at once. Separators leave the search as plain rows, which
are written once and meet their block's place in a join, so windows see block summaries only.

A file that doesn't end with a separator has a last document that isn't complete. Two separators in a row
are a document without ids. Blocks without separators, and documents over many blocks, are ordinary cases.
An empty file has no documents. The scan keeps file, ordinal and place of every document.

Blocks with a null payload, file or number are left out, blocks with an empty one add nothing. A row that repeats a block counts as the same
ids once more at its place. An empty table has no documents. Extra columns aren't read. In the query a null text is
a document without ids, as an empty one is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.words import PIECE, column_bytes, row_slices
from reelframe.session import written_table

CHUNK = 4096
#: Bytes of the blocks in a row group, which a reader holds at once; a larger block has a group of its own.
GROUP_BYTES = 1 << 24
#: Separators that leave the search in one Arrow batch, or those of one block.
BATCH_ENDS = 1 << 16
#: Byte vocabulary: ids 0 to 255 are the bytes of UTF-8.
BYTE_END = 256


def _flat(batches: Iterator[pa.RecordBatch], width: int, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    file = TaskContext.get().partitionId()
    held, size, block, ordinal = [], 0, 0, 0

    def rows(payloads: list[bytes], first: int) -> pa.RecordBatch:
        n = len(payloads)
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([file] * n, pa.int32()),
                "block": pa.array(range(first, first + n), pa.int64()),
                "payload": pa.array(payloads, pa.binary()),
                "ordinal": pa.array([None] * n, pa.int64()),
                "doc_ids": pa.array([None] * n, pa.list_(pa.int64())),
            }
        )

    for batch in batches:
        for a, z in row_slices(batch.column("text")):
            offsets, data = column_bytes(batch.column("text").slice(a, z - a))
            ends, done = offsets[1:], 0
            for p in range(int(offsets[0]), max(int(ends[-1]), int(offsets[0]) + 1), PIECE):  # once for rows without bytes, too
                q = min(p + PIECE, int(ends[-1]))
                upto = int(np.searchsorted(ends, q, "right"))
                held.append(np.insert(data[p:q].astype(f"<u{width}"), ends[done:upto] - p, end_id))
                size, done = size + len(held[-1]), upto
                if size >= block_ids:
                    stream = np.concatenate(held)
                    full = size // block_ids
                    yield rows([stream[i * block_ids : (i + 1) * block_ids].tobytes() for i in range(full)], block)
                    held, size, block = [stream[full * block_ids :].copy()], size - full * block_ids, block + full
            names = batch.column("doc_id").slice(a, z - a)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([file], pa.int32()),
                    "block": pa.array([None], pa.int64()),
                    "payload": pa.array([None], pa.binary()),
                    "ordinal": pa.array([ordinal], pa.int64()),
                    "doc_ids": pa.array([names.to_pylist()], pa.list_(pa.int64())),
                }
            )
            ordinal += z - a
    if size:
        yield rows([np.concatenate(held).tobytes()], block)


def write_flat_files(docs: DataFrame, folder: str, width: int = 2, end_id: int = BYTE_END, block_ids: int = 1 << 19) -> None:
    """Flat files of the byte ids of the texts, one per input partition, with an end id after each text.

    Rows with a payload are the streams; rows with doc_ids name the documents for whoever wants ids
    beside ordinals, and the scan doesn't read them.
    """
    group_rows = max(1, GROUP_BYTES // (block_ids * width))
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_flat, width=width, end_id=end_id, block_ids=block_ids), "file int, block long, payload binary, ordinal long, doc_ids array<long>"
    ).write.option("compression", "zstd").option("parquet.block.row.count.limit", group_rows).parquet(folder)


FOUND = "row long, file int, block long, i long, at long, length long, last boolean"


def _search(batches: Iterator[pa.RecordBatch], width: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """A row per separator: its number and place in the block, the ids before it since the one before or the block's start.

    The last row of a block says the same of the block's end. ``row`` tells repeated blocks apart.
    """
    row = TaskContext.get().partitionId() << 33
    held, size = [], 0

    def found() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "file", "block", "i", "at", "length", "last"])

    for batch in batches:
        for file, block, payload in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            ids = np.frombuffer(payload.as_buffer(), f"<u{width}")
            at = np.append(np.flatnonzero(ids == end_id), len(ids))
            n = len(at)
            i = np.arange(n)
            held.append((np.full(n, row), np.full(n, file, np.int32), np.full(n, block), i, at, np.diff(at, prepend=-1) - 1, i == n - 1))
            row, size = row + 1, size + n
            if size >= BATCH_ENDS:
                yield found()
                held, size = [], 0
    if held:
        yield found()


def _before(rows: DataFrame, keys: list[str], order: list[str], p: str) -> DataFrame:
    """Exclusive prefix sums of ``seps`` and ``ids``, and the ids since the last separator (``open``).

    ``tail`` is what a row leaves open. ``fresh`` says that no separator stands before the row.
    """
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("seps", "ids", "tail")}
    rows = rows.withColumns({f"{p}{c}": v for c, v in sums.items()})
    base = F.last(F.when(F.col("seps") > 0, F.col(f"{p}tail")), ignorenulls=True).over(upto)
    return rows.withColumns({f"{p}fresh": F.col(f"{p}seps") == 0, f"{p}open": F.col(f"{p}tail") - F.coalesce(base, F.lit(0))})


def count_tokens(files: DataFrame, width: int = 2, end_id: int = BYTE_END) -> DataFrame:
    """file, ordinal, start (ids before the document in its file), n_tokens without the end id, complete.

    ``files`` has file, block (from 0, in order) and payload.
    """
    found = files.where("payload IS NOT NULL AND file IS NOT NULL AND block IS NOT NULL").select("file", "block", "payload")
    found = written_table(found.mapInArrow(partial(_search, width=width, end_id=end_id), FOUND), "separators")
    blocks = found.where("last").select(
        "row", "file", "block", F.floor(F.col("block") / CHUNK).alias("chunk"), F.col("i").alias("seps"), F.col("at").alias("ids"), F.col("length").alias("tail")
    )
    inside = _before(blocks, ["file", "chunk"], ["block", "row"], "b_")
    # What a chunk leaves open: after its last block.
    left = F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("b_open") + F.col("tail"))
    chunks = inside.groupBy("file", "chunk").agg(
        F.sum("seps").alias("seps"), F.sum("ids").alias("ids"), F.max_by(left, F.struct("block", "row")).alias("tail")
    )
    around = _before(chunks, ["file"], ["chunk"], "c_")
    last = F.max("chunk").over(Window.partitionBy("file"))
    around = around.withColumn("last_chunk", last).select("file", "chunk", "c_seps", "c_ids", "c_open", "last_chunk", F.col("seps").alias("own"), F.col("tail").alias("end_open"), F.col("ids").alias("own_ids"))
    placed = inside.where("seps > 0").join(around, ["file", "chunk"]).select(
        "row",
        "file",
        (F.col("c_seps") + F.col("b_seps")).alias("ordinal0"),
        (F.col("b_open") + F.when(F.col("b_fresh"), F.col("c_open")).otherwise(F.lit(0))).alias("carry"),
        (F.col("c_ids") + F.col("b_ids")).alias("at0"),
    )
    documents = found.where("NOT last").select("row", "i", "at", "length").join(placed, "row")
    length = F.col("length") + F.when(F.col("i") == 0, F.col("carry")).otherwise(F.lit(0))
    complete = documents.select(
        "file", (F.col("ordinal0") + F.col("i")).alias("ordinal"), (F.col("at0") + F.col("at") - length).alias("start"), length.alias("n_tokens"), F.lit(True).alias("complete")
    )
    rest = F.col("end_open") + F.when(F.col("own") == 0, F.col("c_open")).otherwise(F.lit(0))
    open_ = around.where(F.col("chunk") == F.col("last_chunk")).where(rest > 0).select(
        "file",
        (F.col("c_seps") + F.col("own")).alias("ordinal"),
        (F.col("c_ids") + F.col("own_ids") - rest).alias("start"),
        rest.alias("n_tokens"),
        F.lit(False).alias("complete"),
    )
    return complete.unionByName(open_)


def named(counts: DataFrame, files: DataFrame) -> DataFrame:
    """The counts with doc_id, from the rows that name documents; their lists are far longer than the size of their files says, so no broadcast."""
    names = files.where("doc_ids IS NOT NULL").select("file", "ordinal", F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "doc_id")
    return counts.join(names.hint("merge"), ["file", "ordinal"])
