"""Words of whole texts as 64-bit hashes, computed with NumPy over Arrow text columns.

Words are the runs of ``[^\\x20\\x09-\\x0D]``. All separators are single bytes in UTF-8, so words are
cut in the bytes. A word's hash is a polynomial over a random table of its bytes, taken from prefix sums
modulo 2^64, then mixed. Long texts go through in pieces cut at separators, so memory beyond the hashes
themselves (8 bytes a word) doesn't grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[65:91] += _U(32)
    return mix((codes + _U(1)) * _U(_ODD))


def _blank_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


BLANK_BYTES = _blank_bytes()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD6E8FEB86659FD93
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def word_spans(data: np.ndarray, breaks: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word; no word crosses a break, where the next row starts."""
    inside = ~separators[data]
    new = np.zeros(len(data) + 1, bool)
    new[breaks] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | new[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | new[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of byte spans, equal for equal bytes wherever they stand."""
    n = max(PIECE + 1, 1 << int(len(data)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(_ODD))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)


def pieces(offsets: np.ndarray, data: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(first row, end row, byte ranges): many small rows in one range, or one long row in several."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        a, z = int(offsets[row]), int(offsets[end])
        ranges = []
        while z - a > PIECE:
            back = np.flatnonzero(sep[data[a : a + PIECE]])
            if len(back):
                cut = a + int(back[-1]) + 1
            else:  # one word longer than a piece stays whole
                ahead = a + PIECE
                while ahead < z and not sep[data[ahead : ahead + PIECE]].any():
                    ahead += PIECE
                hit = np.flatnonzero(sep[data[ahead : min(z, ahead + PIECE)]])
                cut = min(z, ahead + int(hit[0]) + 1) if len(hit) else z
            ranges.append((a, cut))
            a = cut
        ranges.append((a, z))
        yield row, end, ranges
        row = end


def row_spans(
    texts: pa.Array, lower: bool = False, separators: np.ndarray = BLANK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, its bytes, its words' hashes in order, where they start) for every row, empty rows included.

    ``separators`` marks the bytes that no word holds; bytes of 128 and more must not be among them.
    """
    offsets, data = column_bytes(texts)
    for first, end, ranges in pieces(offsets, data, separators):
        hashes, starts = [], []
        rows = offsets[first : end + 1]
        for a, z in ranges:
            s, e = word_spans(data[a:z], rows[(rows >= a) & (rows <= z)] - a, separators)
            hashes.append(span_hashes(data[a:z], s, e, lower))
            starts.append(s + a)
        h, s = np.concatenate(hashes), np.concatenate(starts)
        cuts = np.searchsorted(s, rows)
        for r in range(first, end):
            i, j = cuts[r - first], cuts[r - first + 1]
            yield r, data[offsets[r] : offsets[r + 1]], h[i:j], s[i:j] - offsets[r]


def row_word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order) for every row, empty rows included."""
    for row, _, hashes, _ in row_spans(texts, lower):
        yield row, hashes


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words; shorter texts give their whole sequence, empty ones nothing."""
    k = min(n, len(words))
    if k == 0:
        return words
    g = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        g = mix(g * _U(_ODD) + words[j : len(words) - k + 1 + j])
    return g


def row_slices(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes; a longer row stands alone."""
    offsets, _ = column_bytes(texts)
    a, n = 0, len(offsets) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, z
        a = z
