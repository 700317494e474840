"""SentencePiece encoding and decoding by a batched Viterbi search in NumPy.

Texts are cut where a new word begins (at a run of spaces), distinct words are grouped by length, and all
words of a length advance together: hashes of their substrings probe the sorted piece keys, and a
vectorised maximum per position stores the length of the best last piece. A piece scores what the model
file says. A character that is no piece costs ``UNKNOWN_PENALTY`` less than the worst piece in use and becomes its
UTF-8 bytes. On equal scores the longer last piece wins. No piece holds a space inside, so the best
segmentation of a text is that of its words, one after the other.

The result is the best segmentation under the scores of the file, added in double precision: for known characters
what the library returns for a model of kind unigram with these pieces. Decoding is exact for either kind of model.

Null text counts as empty and gives no ids. Any other text decodes to itself, NUL and line breaks
included. Repeated rows give equal ids. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.words import mix, row_slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
UNUSED = -1e8  # pieces below are in the file but not meant to be chosen
CACHE_WORDS = 400_000
CELLS = 1 << 21
_U = np.uint64


@dataclass(frozen=True)
class Pieces:
    """Ordinary pieces with scores, byte pieces, and the bytes that each id decodes to."""

    texts: tuple[str, ...]
    scores: np.ndarray
    ordinary: np.ndarray
    byte_ids: np.ndarray
    unknown: int


def load(path: str) -> Pieces:
    """Pieces of a model file; read on the driver and sent along, so workers need no file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    texts = tuple(sp.id_to_piece(i) for i in range(n))
    kinds = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    bytes_ = np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            bytes_[int(texts[i][3:-1], 16)] = i
    return Pieces(texts, np.array([sp.get_score(i) for i in range(n)], np.float32), ~np.array(kinds, bool), bytes_, sp.unk_id())


def _codes(words: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    up = np.full(n, base, np.uint64)
    down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _substring_keys(codes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all substrings of one length, for words of equal length in rows."""
    n = codes.shape[1]
    up, down = _powers(1 << max(6, n.bit_length()))
    sums = np.zeros((len(codes), n + 1), np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * up[:n], axis=1, out=sums[:, 1:])
    return _keyed(sums, down, length)


def _keyed(sums: np.ndarray, down: np.ndarray, length: int) -> np.ndarray:
    n = sums.shape[1] - 1
    return mix((sums[:, length:] - sums[:, : n + 1 - length]) * down[: n + 1 - length] + _U(length))


class Encoder:
    """Ids of words and texts; keeps the ids of words met so far, ``CACHE_WORDS`` at most."""

    def __init__(self, pieces: Pieces) -> None:
        ids = np.flatnonzero(pieces.ordinary)
        lengths = np.array([len(pieces.texts[i]) for i in ids])
        keys = np.zeros(len(ids), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            keys[at] = _substring_keys(_codes(pieces.texts[ids[i]] for i in at).reshape(len(at), n), int(n))[:, 0]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        self.scores = pieces.scores[self.ids].astype(np.float64)  # sums of large penalties must not swallow small scores
        self.sizes = [int(n) for n in np.unique(lengths)]
        self.worst = float(self.scores[self.scores > UNUSED].min()) - UNKNOWN_PENALTY
        self.pieces = pieces
        self.cache: dict[str, bytes] = {}

    def _longest(self, n: int) -> int:
        return min(n, self.sizes[-1])

    def segment(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last piece length, last piece id or -1) for every prefix of words of equal length in rows."""
        rows, n = codes.shape
        most = self._longest(n)
        up, down = _powers(1 << max(6, n.bit_length()))
        sums = np.zeros((rows, n + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * up[:n], axis=1, out=sums[:, 1:])
        found, gain = {}, {}
        for size in self.sizes:
            if size > n:
                break
            keys = _keyed(sums, down, size)
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            hit = self.keys[at] == keys
            found[size] = np.where(hit, self.ids[at], -1)
            gain[size] = np.where(hit, self.scores[at], -np.inf)
        if 1 in gain:
            gain[1] = np.where(found[1] < 0, self.worst, gain[1])
        else:
            found[1], gain[1] = np.full((rows, n), -1, np.int32), np.full((rows, n), self.worst)
        best = np.zeros((rows, n + 1))
        back, last = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32)
        everyone = np.arange(rows)
        for end in range(1, n + 1):
            sizes = [s for s in range(min(most, end), 0, -1) if s in gain]  # longer pieces win ties
            options = np.stack([best[:, end - s] + gain[s][:, end - s] for s in sizes])
            pick = np.argmax(options, axis=0)
            best[:, end] = options[pick, everyone]
            back[:, end] = np.array(sizes, np.int32)[pick]
            for k, s in enumerate(sizes):
                chosen = pick == k
                last[chosen, end] = found[s][chosen, end - s]
        return back, last

    def _words(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, group in by_length.items():
            step = max(1, CELLS // (n * (self._longest(n) + 4)))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                back, last = self.segment(_codes(part).reshape(len(part), n))
                self._trace(part, n, back, last)

    def _trace(self, words: list[str], n: int, back: np.ndarray, last: np.ndarray) -> None:
        """Follow the backpointers of all words at once."""
        end = np.full(len(words), n)
        rows, ids, ends = [], [], []
        alive = np.arange(len(words))
        while len(alive):
            at = end[alive]
            rows.append(alive)
            ids.append(last[alive, at])
            ends.append(at)
            end[alive] = at - back[alive, at]
            alive = alive[end[alive] > 0]
        row, piece, upto = np.concatenate(rows), np.concatenate(ids), np.concatenate(ends)
        order = np.lexsort((upto, row))
        row, piece, upto = row[order], piece[order], upto[order]
        cuts = np.searchsorted(row, np.arange(len(words) + 1))
        odd = np.zeros(len(words), bool)
        odd[row[piece < 0]] = True
        flat = piece.astype("<i4")
        for i, w in enumerate(words):
            own = flat[cuts[i] : cuts[i + 1]]
            if odd[i]:
                out = []
                for p, e in zip(own.tolist(), upto[cuts[i] : cuts[i + 1]].tolist(), strict=True):
                    if p >= 0:
                        out.append(p)
                    else:
                        out += self._spelled(w[e - 1])
                own = np.array(out, "<i4")
            self.cache[w] = own.tobytes()

    def _spelled(self, character: str) -> list[int]:
        ids = self.pieces.byte_ids[list(character.encode("utf-8", "surrogatepass"))]
        return ids.tolist() if (ids >= 0).all() else [self.pieces.unknown]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        split = [_split(t) if t else [] for t in texts]
        missing = set().union(*split).difference(self.cache)
        if len(missing) + len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            missing = set().union(*split)
        self._words(list(missing))
        take = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(take, words)), "<i4") for words in split]


def _split(text: str) -> list[str]:
    """Words with the spaces before them as ``SPACE``; a space is put before the text."""
    if SPACE in text:
        text = text.replace(SPACE, " ")
    parts = text.split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, spaces = [], 0
    for p in parts:
        spaces += 1
        if p:
            out.append(SPACE * spaces + p)
            spaces = 0
    if spaces:
        out.append(SPACE * spaces)
    return out


class Decoder:
    """Texts of ids: the bytes of all pieces lie in one pool and are gathered by offsets."""

    def __init__(self, pieces: Pieces) -> None:
        raw = [t.replace(SPACE, " ").encode() if o else b"" for t, o in zip(pieces.texts, pieces.ordinary, strict=True)]
        for value, i in enumerate(pieces.byte_ids.tolist()):
            if i >= 0:
                raw[i] = bytes([value])
        raw[pieces.unknown] = " ⁇ ".encode()
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return ""
        at = np.repeat(self.start[ids] - (ends - size), size) + np.arange(ends[-1])
        return self.pool[at].tobytes()[1:].decode("utf-8", "replace")  # without the space put before the text


def plain_text(text: str | None) -> str:
    """What decoding returns: the marker of spaces in a text is read as a space."""
    return (text or "").replace(SPACE, " ")


def _encode(batches: Iterator[pa.RecordBatch], pieces, text: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, decoder = Encoder(pieces.value), Decoder(pieces.value)
    for batch in batches:
        column = batch.column(text)
        for a, z in row_slices(column):
            texts = column.slice(a, z - a).to_pylist()
            ids = encoder.encode(texts)
            own = batch.slice(a, z - a)
            out = {name: own.column(name) for name in own.schema.names if name != text}
            out["n_pieces"] = pa.array([len(x) for x in ids], pa.int64())
            out["ids_crc32"] = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
            out["restored"] = pa.array([decoder.decode(x) == plain_text(t) for x, t in zip(ids, texts, strict=True)], pa.bool_())
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)


def encode(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """The id column, n_pieces, the crc32 of the ids (little-endian 32-bit), whether they decode to the text, and the ids."""
    pieces = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_pieces long, ids_crc32 long, restored boolean"
    return docs.select(F.col(id_column), F.col(text)).mapInArrow(
        partial(_encode, pieces=pieces, text=text, keep_ids=keep_ids), schema + (", ids array<int>" if keep_ids else "")
    )


def _decode(batches: Iterator[pa.RecordBatch], pieces, ids: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(pieces.value)
    for batch in batches:
        texts = [decoder.decode(np.asarray(x.values, np.int32)) if x.is_valid else None for x in batch.column(ids)]
        out = {name: batch.column(name) for name in batch.schema.names if name != ids}
        yield pa.RecordBatch.from_pydict(out | {"text": pa.array(texts, pa.string())})


def decode(encoded: DataFrame, path: str, ids: str = "ids", id_column: str = "doc_id") -> DataFrame:
    """The id column and the text of each list of ids; null ids give null."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load(path))
    schema = f"{id_column} {encoded.schema[id_column].dataType.simpleString()}, text string"
    return encoded.select(F.col(id_column), F.col(ids)).mapInArrow(partial(_decode, pieces=pieces, ids=ids), schema)
