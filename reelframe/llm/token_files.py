"""Token files of fixed-width packed ids, with block offsets for vectorised unpacking and random access.

Every id takes the fewest bits that hold the vocabulary. A file holds blocks in ascending order; a block
holds whole documents, is closed once it has ``block_tokens`` ids, and carries its first id's place in
the file, its number of ids, and its documents with their offsets. So any block unpacks by itself with
NumPy, and a document is found by its block without reading others. Files are rows of Parquet, one file a
range of doc_id, which Spark commits whole; an executor that is lost leaves nothing behind.

Documents stand in ascending doc_id order (null first; repeated ids by text). Null and empty text have no
ids but the end id. A document longer than a block makes a block of its own. Extra columns aren't read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.words import BLANK_BYTES, PIECE, column_bytes, pieces, row_slices, span_hashes
from reelframe.session import scratch_root, written_table

GENERATION = 400_000
BLOCK = "file int, block int, first long, n_tokens long, bits int, payload binary, doc_ids array<long>, doc_offsets array<long>"


def bits_of(vocabulary: int) -> int:
    """Fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, ``bits`` each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` of a packed block; touches only their bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    a = start * bits // 8
    z = ((start + count) * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, z - a, a), bitorder="little")
    spread = flat[start * bits - 8 * a :][: count * bits].reshape(count, bits)
    return spread @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters, digits, marks = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True
    digits[48:58] = True
    marks[33:127] = True
    return letters, digits, marks & ~letters & ~digits


LETTERS, DIGITS, MARKS = _classes()
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 32), 32])
#: First bytes of white space beyond ASCII; rows with one are looked at as text.
WIDE_BLANK = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


class TokenEncoder:
    """Ids of texts by a tokenizer with the usual byte-level split; equal units are encoded once.

    The split of the tokenizer never joins what stands on both sides of a single space or line break, nor
    an ASCII letter or digit and the mark after it, nor such a letter and a digit. Texts are cut there in
    their bytes, units are told apart by 64-bit hashes, and the library encodes each unit that this worker
    hasn't met lately. Texts with runs of white space or with marks of special tokens go to the library as
    they are, long ones in parts cut at single spaces.
    """

    RUNS = re.compile(r"\s\s|<\|")
    SINGLE_SPACE = re.compile(r"(?<=[^\s|<]) (?=[^\s|<])")

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # Units met lately, and those of the time before; at most two generations are held.
        self.cache: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _whole(self, text: str) -> np.ndarray:
        parts, a = [], 0
        while len(text) - a > PIECE:
            cut = self.SINGLE_SPACE.search(text, a + PIECE)
            if not cut:
                break
            parts.append(text[a : cut.start()])
            a = cut.start()
        return np.frombuffer(b"".join(b for t in [*parts, text[a:]] for b in self._plain([t])), np.uint32)

    def _odd_rows(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows that can't be cut in their bytes."""
        blank = BLANK[data]
        hits = np.flatnonzero(blank[1:] & blank[:-1])
        marks = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        odd = np.zeros(len(rows) - 1, bool)
        of = np.searchsorted(rows, np.concatenate([hits, marks]), "right") - 1
        odd[of] = True
        for r in np.unique(np.searchsorted(rows, np.flatnonzero(WIDE_BLANK[data]), "right") - 1):
            odd[r] = odd[r] or bool(self.RUNS.search(data[rows[r] : rows[r + 1]].tobytes().decode()))
        return odd

    @staticmethod
    def _starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where units start: at rows, spaces, line breaks and after them, and where the kind of character changes."""
        cut = np.zeros(len(data) + 1, bool)
        letter, digit, mark, line = LETTERS[data], DIGITS[data], MARKS[data], data == 10
        cut[:-1] = line | (data == 32)
        cut[1:] |= line
        cut[1:-1] |= (letter | digit)[:-1] & mark[1:] | letter[:-1] & digit[1:] | digit[:-1] & letter[1:]
        # Two-byte letters of Western European languages, before a mark.
        wide = (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7) & mark[2:]
        cut[2:-1] |= wide
        cut[rows[:-1]] = True
        return np.flatnonzero(cut[:-1])

    def _pooled(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in order, number of ids of each unit)."""
        keys, first, inverse = np.unique(span_hashes(data, starts, ends, False), return_index=True, return_inverse=True)
        if len(self.cache) > GENERATION:
            self.older, self.cache = self.cache, {}
        known, older, keys = self.cache, self.older, keys.tolist()
        ids = [known.get(k) for k in keys]
        fresh = []
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = known[keys[i]] = older.get(keys[i])
            if ids[i] is None:
                fresh.append(i)
        texts = [data[a:z].tobytes().decode() for a, z in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)] if fresh else []
        for i, raw in zip(fresh, self._plain(texts), strict=True):
            ids[i] = known[keys[i]] = raw
        pool = np.frombuffer(b"".join(ids), np.uint32)
        size = np.array([len(x) for x in ids], np.int64) // 4
        at = (np.cumsum(size) - size)[inverse]
        size = size[inverse]
        upto = np.cumsum(size)
        return pool[np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)], size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every row; null counts as empty."""
        offsets, data = column_bytes(texts)
        out: list[np.ndarray] = []
        for first, end, ranges in pieces(offsets, data, BLANK_BYTES):
            rows = offsets[first : end + 1] - offsets[first]
            chunk = data[offsets[first] : offsets[end]]
            odd = self._odd_rows(chunk, rows)
            if odd.all():
                out += [self._whole(chunk[a:z].tobytes().decode()) for a, z in zip(rows, rows[1:])]
                continue
            each = []
            for a, z in ranges:  # a range of a long row ends after a blank, which belongs to the next unit if it is a space
                a, z = (x - offsets[first] for x in (a, z))
                a -= int(a > 0 and chunk[a - 1] == 32)
                z -= int(z < len(chunk) and chunk[z - 1] == 32)
                own = np.clip(rows, a, z) - a
                starts = self._starts(chunk[a:z], own)
                ends = np.append(starts[1:], z - a)
                keep = ~odd[np.searchsorted(rows, starts + a, "right") - 1]
                ids, size = self._pooled(chunk[a:z], starts[keep], ends[keep])
                each.append((ids, size, starts[keep] + a))
            ids = np.concatenate([x[0] for x in each])
            upto = np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in each]))])
            cuts = upto[np.searchsorted(np.concatenate([x[2] for x in each]), rows)]
            for r in range(end - first):
                out.append(self._whole(chunk[rows[r] : rows[r + 1]].tobytes().decode()) if odd[r] else ids[cuts[r] : cuts[r + 1]])
        return out


@lru_cache(maxsize=1)
def shared_encoder(definition: str) -> TokenEncoder:
    """One encoder a worker process, so that tasks of a worker share what it has met."""
    return TokenEncoder(definition)


def _blocks(batches: Iterator[pa.RecordBatch], definition, bits: int, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    encoder, file = shared_encoder(definition.value), TaskContext.get().partitionId()
    block, first = 0, 0
    ids, names, offsets, size = [], [], [], 0
    end = np.array([end_id], np.uint32)

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {
                "file": pa.array([file], pa.int32()),
                "block": pa.array([block], pa.int32()),
                "first": pa.array([first], pa.int64()),
                "n_tokens": pa.array([size], pa.int64()),
                "bits": pa.array([bits], pa.int32()),
                "payload": pa.array([pack(np.concatenate(ids), bits)], pa.binary()),
                "doc_ids": pa.array([names], pa.list_(pa.int64())),
                "doc_offsets": pa.array([offsets], pa.list_(pa.int64())),
            }
        )

    for batch in batches:
        for a, z in row_slices(batch.column("text")):
            each = encoder.encode(batch.column("text").slice(a, z - a))
            for name, own in zip(batch.column("doc_id").slice(a, z - a).to_pylist(), each, strict=True):
                names.append(name)
                offsets.append(size)
                ids += [own, end]
                size += len(own) + 1
                if size >= block_tokens:
                    yield closed()
                    block, first = block + 1, first + size
                    ids, names, offsets, size = [], [], [], 0
    if names:
        yield closed()


def write_token_files(docs: DataFrame, definition: str, folder: str, vocabulary: int, end_id: int = 0, block_tokens: int = 1 << 16) -> None:
    """Encode doc_id and text with a tokenizer (its JSON) and write the files into ``folder``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(
        partial(_blocks, definition=shared, bits=bits_of(vocabulary), end_id=end_id, block_tokens=block_tokens), BLOCK
    ).write.parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``, the ids before each in all files."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # One row per file.
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    starts = written_table(files.select(F.col("file").alias("of_file"), F.coalesce(before, F.lit(0)).alias("before")), "token-starts")
    return blocks.join(starts, F.col("file") == F.col("of_file")).withColumn("start", F.col("before") + F.col("first")).drop("of_file", "before")


def _documents(batches: Iterator[pa.RecordBatch], keep_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = unpack(row["payload"], row["bits"], 0, row["n_tokens"])
            edges = [*row["doc_offsets"], row["n_tokens"]]
            each = [ids[a:z] for a, z in zip(edges, edges[1:])]
            out = {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "start": pa.array([row["start"] + o for o in row["doc_offsets"]], pa.int64()),
                "n_tokens": pa.array([len(x) for x in each], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64()),
            }
            if keep_ids:
                out["ids"] = pa.array(each, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)


def read_documents(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens (end id included), ids_crc32 and, if asked for, the ids of every document in the files."""
    wanted = read_blocks(spark, folder).select("start", "n_tokens", "bits", "payload", "doc_ids", "doc_offsets")
    return wanted.mapInArrow(
        partial(_documents, keep_ids=keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for files in the place that all executors share; ``release_tables`` deletes it."""
    return f"{scratch_root(spark)}/reelframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
