"""Masks of whole frames as packed bits: one row a frame, eight pixels a byte.

A mask row has the keys, ``bits`` (row by row, most significant bit first, set where the pixel is masked), ``height`` and
``width``; a mask of 1920 x 960 takes 230 kB. Counting, joining and intersecting masks work on the packed bytes, a batch at
a time. Masks of another size than their frame are scaled to it by nearest pixel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.functions import kernels as N
from reelframe.operators.pixels import _ddl

SALT = 16
_MASK = ["bits", "height", "width"]
_MASK_DDL = "bits binary, height int, width int"


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool)).tobytes()


def unpacked(bits: bytes, height: int, width: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=height * width).reshape(height, width).astype(bool)


@lru_cache(maxsize=64)
def removed_region(height: int, width: int, kind: str, ratio: float | None = None) -> np.ndarray:
    """True where a region mask removes the pixel; kinds and default ratios as in ``pixel_tables.region_mask``."""
    y, x = np.ogrid[:height, :width]
    share = {"fisheye": 0.94, "polar": 0.10, "nadir": 0.15, "zenith": 0.05}[kind] if ratio is None else ratio
    if kind == "polar":
        margin = int(height * share)
        return np.broadcast_to((y < margin) | (y >= height - margin), (height, width)) if margin > 0 else np.zeros((height, width), bool)
    if kind == "fisheye":
        radius = int(min(width, height) * 0.5 * min(max(share, 0.0), 1.0))
        cy, outside = height // 2, True
    else:
        radius = int(height * share)
        cy, outside = (height - radius if kind == "nadir" else radius), False
    disc = (x - width // 2) ** 2 + (y - cy) ** 2 <= radius * radius
    if outside:
        return ~disc if radius > 0 else np.ones((height, width), bool)
    return disc


def mask_where(frames: DataFrame, keys: Sequence[str], test: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Packed mask of the pixels of each payload that ``test`` gives as true."""
    keys = list(keys)

    def run(batches):
        for pdf in batches:
            out = pdf[[*keys, "height", "width"]].copy()
            shapes = zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"], strict=True)
            out["bits"] = [packed(test(N.decode(*s))) for s in shapes]
            yield out[[*keys, *_MASK]]

    return frames.select(*keys, "data", "height", "width", "channels").mapInPandas(run, f"{_ddl(frames, keys)}, {_MASK_DDL}")


def region_masks(sizes: DataFrame, keys: Sequence[str], kind: str, ratio: float | None = None) -> DataFrame:
    """Packed region mask of each frame; ``sizes`` has the keys, ``height`` and ``width``."""
    keys = list(keys)

    def run(batches):
        for pdf in batches:
            out = pdf.copy()
            out["bits"] = [packed(removed_region(int(h), int(w), kind, ratio)) for h, w in zip(pdf["height"], pdf["width"], strict=True)]
            yield out[[*keys, *_MASK]]

    return sizes.select(*keys, "height", "width").mapInPandas(run, f"{_ddl(sizes, keys)}, {_MASK_DDL}")


def _filled(img: np.ndarray, mask: np.ndarray, fill) -> bytes:
    if mask.shape != img.shape[:2]:
        mask = N.resize_nearest(mask.astype(np.uint8), *img.shape[:2]) > 0
    out = img.copy()
    out[mask] = fill
    return out.tobytes()


def fill_region(frames: DataFrame, keys: Sequence[str], kind: str, *, ratio: float | None = None, fill: int | Sequence[int] = 0) -> DataFrame:
    """Frames with a region set to ``fill``; payloads stay in the map stage."""
    return _fill(frames, keys, fill, lambda r, h, w: removed_region(h, w, kind, ratio), [])


def fill_masked(frames: DataFrame, masks: DataFrame, keys: Sequence[str], *, fill: int | Sequence[int] = 0) -> DataFrame:
    """Frames with their masked pixels set to ``fill``; a frame without mask stays as it is."""
    keys = list(keys)
    sided = masks.select(*keys, *[F.col(c).alias(f"m_{c}") for c in _MASK])
    own = lambda r, h, w: None if r.m_bits is None else unpacked(r.m_bits, int(r.m_height), int(r.m_width))
    return _fill(frames.join(sided, keys, "left"), keys, fill, own, [f"m_{c}" for c in _MASK])


def _fill(frames: DataFrame, keys: Sequence[str], fill, mask_of, extra: Sequence[str]) -> DataFrame:
    keys = list(keys)
    cols = [*keys, "data", "height", "width", "channels"]

    def run(batches):
        for pdf in batches:
            out = pdf[cols].copy()
            data = []
            for r in pdf.itertuples(index=False):
                mask = mask_of(r, int(r.height), int(r.width))
                data.append(r.data if mask is None else _filled(N.decode(r.data, r.height, r.width, r.channels), mask, fill))
            out["data"] = data
            yield out

    return frames.select(*cols, *extra).mapInPandas(run, _ddl(frames, cols))


def mask_stats(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and masked pixels, their ratio, and the sums of the masked rows and columns."""
    keys = list(keys)
    fields = ["total_pixels", "masked_pixels", "mask_ratio", "sum_y", "sum_x"]

    def run(batches):
        for pdf in batches:
            rows = []
            for bits, h, w in zip(pdf["bits"], pdf["height"], pdf["width"], strict=True):
                n = int(np.bitwise_count(np.frombuffer(bits, np.uint8)).sum())  # bits behind the last pixel are zero
                mask = unpacked(bits, h, w)
                rows.append((h * w, n, n / (h * w) if h * w else 0.0, int(mask.sum(1) @ np.arange(h)), int(mask.sum(0) @ np.arange(w))))
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=fields)], axis=1)

    ddl = f"{_ddl(masks, keys)}, total_pixels bigint, masked_pixels bigint, mask_ratio double, sum_y bigint, sum_x bigint"
    return masks.select(*keys, *_MASK).mapInPandas(run, ddl)


_OPERATIONS = {"and": np.bitwise_and, "or": np.bitwise_or, "minus": lambda a, b: a & ~b}


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Masks of two tables joined pixel by pixel: ``and``, ``or`` or ``minus``.

    A frame with one mask only keeps it for ``or`` (and, if it is the first, ``minus``) and has none for ``and``; masks
    of different sizes are scaled to the first.
    """
    keys, work = list(keys), _OPERATIONS[how]
    sided = b.select(*keys, *[F.col(c).alias(f"o_{c}") for c in _MASK])
    joined = a.select(*keys, *_MASK).join(sided, keys, {"and": "inner", "or": "full", "minus": "left"}[how])

    def one(r) -> tuple[bytes, int, int]:
        if r.bits is None:
            return r.o_bits, r.o_height, r.o_width
        if r.o_bits is None:
            return r.bits, r.height, r.width
        other = r.o_bits
        if (r.height, r.width) != (r.o_height, r.o_width):
            scaled = N.resize_nearest(unpacked(other, int(r.o_height), int(r.o_width)).astype(np.uint8), int(r.height), int(r.width))
            other = packed(scaled > 0)
        return work(np.frombuffer(r.bits, np.uint8), np.frombuffer(other, np.uint8)).tobytes(), r.height, r.width

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=_MASK).astype({"height": "int32", "width": "int32"})
            yield pd.concat([pdf[keys].reset_index(drop=True), rows], axis=1)

    return joined.mapInPandas(run, f"{_ddl(a, keys)}, {_MASK_DDL}")


def _united(rows: DataFrame, keys: Sequence[str], paint: Callable[[np.ndarray, pd.DataFrame], None]) -> DataFrame:
    """One mask a frame, painted by all of its rows (with ``height`` and ``width``).

    Rows stream past sorted by frame, so a task holds one mask, however many rows a frame has. They are dealt by frame
    and ``_salt`` first and the parts united, so a frame with very many rows is painted by ``SALT`` tasks.
    """
    keys = list(keys)
    ddl = f"{_ddl(rows, keys)}, {_MASK_DDL}"

    def stream(work):
        def run(batches):
            held, name = None, None
            for pdf in batches:
                unit = pdf["_unit"].to_numpy()
                edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(pdf)]
                done = []
                for a, z in zip(edges, edges[1:]):
                    part = pdf.iloc[a:z]
                    if unit[a] != name:
                        done += [held] if held is not None else []
                        h, w = int(part["height"].iat[0]), int(part["width"].iat[0])
                        held, name = (part[keys].iloc[:1], np.zeros((h, w), bool)), unit[a]
                    work(held[1], part)
                if done:
                    yield _rows(done)
            if held is not None:
                yield _rows([held])

        return run

    def _rows(done) -> pd.DataFrame:
        out = pd.concat([k for k, _ in done], ignore_index=True)
        return out.assign(bits=[packed(m) for _, m in done], height=[m.shape[0] for _, m in done], width=[m.shape[1] for _, m in done])

    def unite(mask: np.ndarray, part: pd.DataFrame) -> None:
        for bits in part["bits"]:
            mask |= unpacked(bits, *mask.shape)

    unit = F.to_json(F.struct(*keys))
    parts = rows.withColumn("_unit", unit).repartition(*keys, "_salt").sortWithinPartitions("_unit").mapInPandas(stream(paint), ddl)
    return parts.withColumn("_unit", unit).repartition(*keys).sortWithinPartitions("_unit").mapInPandas(stream(unite), ddl)


def merged(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One mask a frame, masked where any of its masks is; masks of a frame have one size."""

    def unite(mask: np.ndarray, part: pd.DataFrame) -> None:
        for bits in part["bits"]:
            mask |= unpacked(bits, *mask.shape)

    return _united(masks.select(*keys, *_MASK, F.pmod(F.xxhash64("bits"), F.lit(SALT)).alias("_salt")), keys, unite)


def box_masks(boxes: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed mask of each frame in ``sizes``: pixels inside any of its boxes (x1, y1, x2, y2; ends exclusive, cut to the frame)."""
    keys = list(keys)
    whole = lambda c, size: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), size))
    cut = boxes.select(*keys, "x1", "y1", "x2", "y2").join(sizes.select(*keys, "height", "width"), keys)
    cut = cut.select(
        *keys, "height", "width", whole("x1", F.col("width") - 1).alias("a"), whole("x2", F.col("width")).alias("b"),
        whole("y1", F.col("height") - 1).alias("c"), whole("y2", F.col("height")).alias("d"),
    ).where("b > a AND d > c").withColumn("_salt", F.pmod(F.xxhash64("a", "b", "c", "d"), F.lit(SALT)))

    def draw(mask: np.ndarray, part: pd.DataFrame) -> None:
        for a, b, c, d in zip(part["a"], part["b"], part["c"], part["d"], strict=True):
            mask[c:d, a:b] = True

    return _every_frame(sizes, _united(cut, keys, draw), keys)


def _every_frame(sizes: DataFrame, masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The masks, and empty ones for the other frames."""
    none = F.expr("unhex(repeat('00', cast((height * width + 7) div 8 as int)))")
    out = sizes.select(*keys, "height", "width").join(masks.select(*keys, "bits"), list(keys), "left")
    return out.select(*keys, F.coalesce("bits", none).alias("bits"), "height", "width")


def instance_masks(instances: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packed mask of each frame in ``sizes``: pixels in any of its instances' masks; those of another size are left out."""
    keys = list(keys)
    right = instances.select(*keys, *_MASK).join(sizes.select(*keys, "height", "width"), [*keys, "height", "width"])
    return _every_frame(sizes, merged(right, keys), keys)
