"""Result files as DataFrames of rows or text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions.pose import export_intrinsics
from reelframe.plans.blocks import attach

# Columns of the quality report; the last ones hold score bags.
QUALITY_COLUMNS = ("frame_index", "timestamp", "quality", "quality_lens_a", "quality_lens_b", "is_pass", "drop_reason")
QUALITY_BAGS = (
    "raw_metrics",
    "norm_metrics",
    "lens_a_raw",
    "lens_a_norm",
    "lens_b_raw",
    "lens_b_norm",
    "legacy_quality_scores",
)


def sorted_json(bag: str | Column) -> Column:
    """JSON text of a map with sorted keys; ``{}`` for null."""
    m = F.col(bag) if isinstance(bag, str) else bag
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m)))), F.lit("{}"))


def quality_metrics_rows(records: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Rows of the quality report; absent columns are null and absent bags empty."""
    have = set(records.columns)
    plain = [F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in QUALITY_COLUMNS]
    bags = [(sorted_json(c) if c in have else F.lit("{}")).alias(c) for c in QUALITY_BAGS]
    return records.select(*keys, *plain, *bags)


def vo_trajectory_rows(frames: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Twelve-column trajectory rows; a pose of the wrong length is left empty."""
    t, q, m = F.col("t_xyz"), F.col("q_wxyz"), F.col("metrics")
    number = lambda name: F.coalesce(F.element_at(m, name).cast("double"), F.lit(0.0)).alias(name)
    return frames.select(
        *keys,
        F.col("frame_index").alias("frame_idx"),
        *[F.when(F.size(t) == 3, t[i]).alias(f"t_{c}") for i, c in enumerate("xyz")],
        *[F.when(F.size(q) == 4, q[i]).alias(f"q_{c}") for i, c in enumerate("wxyz")],
        *[number(n) for n in ("vo_valid", "vo_inlier_ratio", "vo_step_proxy", "vo_confidence")],
    )


def write_ordered(rows: DataFrame, path: str, order: Sequence[str], *, format: str = "csv") -> None:
    """Write rows in order over many part files (part names follow the order)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    if format == "text":
        placed.select("text").write.mode("overwrite").text(path)
    else:
        placed.write.mode("overwrite").option("header", True).format(format).save(path)


def keyframe_metadata_lines(summaries: DataFrame, keyframes: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """One JSON document per video as ordered lines (``line_no``, ``text``).

    ``summaries`` has one row per video with a JSON ``header`` (text of an object);
    ``keyframes`` has frame_index, timestamp, combined_score and score bags. A line per
    keyframe keeps the document of a long video spread over many tasks.
    """
    keys = list(keys)
    bags = [c for c in ("quality_scores", "geometric_scores", "adaptive_scores", "stage3_scores") if c in keyframes.columns]
    rounded = lambda c: F.transform_values(F.col(c), lambda _, v: F.bround(v, 4)).alias(c)
    doc = F.to_json(
        F.struct(
            "frame_index",
            F.bround("timestamp", 3).alias("timestamp"),
            F.bround("combined_score", 4).alias("combined_score"),
            *[rounded(c) for c in bags],
        )
    )
    last = keyframes.groupBy(*keys).agg(F.max("frame_index").alias("_last"), F.count(F.lit(1)).alias("_n"))
    body = attach(keyframes, last, keys, F.col("frame_index")).select(
        *keys,
        F.col("frame_index").alias("line_no"),
        F.concat(doc, F.when(F.col("frame_index") < F.col("_last"), ",").otherwise("")).alias("text"),
    )
    head = summaries.join(last, keys, "left")
    opening = F.concat(
        F.col("header").substr(F.lit(1), F.length("header") - 1),
        F.when(F.length(F.trim("header")) > 2, ",").otherwise(""),
        F.lit('"keyframe_count":'),
        F.coalesce(F.col("_n"), F.lit(0)).cast("string"),
        F.lit(',"keyframes":['),
    )
    first = head.select(*keys, F.lit(-1).cast("bigint").alias("line_no"), opening.alias("text"))
    end = head.select(*keys, F.lit((1 << 62)).cast("bigint").alias("line_no"), F.lit("]}").alias("text"))
    return first.unionByName(body).unionByName(end)


def colmap_rows(images: DataFrame) -> DataFrame:
    """Add ``camera_id`` and ``image_name`` from ``folder`` and ``file_name``."""
    folder = F.col("folder")
    camera = F.when(folder.isin("L", "F"), 2).when(folder == "R", 3).otherwise(1)
    name = F.when(folder.isin("L", "R", "F"), F.concat(folder, F.lit("__"), F.col("file_name"))).otherwise(F.col("file_name"))
    return images.withColumn("camera_id", camera).withColumn("image_name", name)


def colmap_cameras(images: DataFrame, calibrations: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Camera lines: one per used camera; ``calibrations`` has camera_id and ``k``.

    ``images`` carries ``width`` and ``height`` of its video.
    """
    used = colmap_rows(images).groupBy(*keys, "camera_id").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    cams = used.join(calibrations.select(*keys, "camera_id", "k"), [*keys, "camera_id"], "left")
    p = export_intrinsics("k", F.col("width"), F.col("height"))
    line = F.format_string(
        "%d PINHOLE %d %d %.6f %.6f %.6f %.6f", "camera_id", F.col("width").cast("bigint"), F.col("height").cast("bigint"), p[0], p[1], p[2], p[3]
    )
    return cams.select(*keys, "camera_id", line.alias("text"))


def colmap_images(images: DataFrame, keys: Sequence[str] = ("video_id",)) -> DataFrame:
    """Image list lines ``name camera``."""
    return colmap_rows(images).select(
        *keys, "image_name", F.format_string("%s %d", "image_name", "camera_id").alias("text")
    )


def export_manifest(
    keyframes: DataFrame,
    *,
    lenses: Sequence[str] = ("",),
    faces: Sequence[str] = (),
    angles: Sequence[tuple[float, float]] = (),
    splits: Sequence[str] = (),
    extension: str = "png",
    prefix: str = "keyframe",
) -> DataFrame:
    """Output path of every keyframe, lens and view.

    The view list is a parameter, so each keyframe fans out by a fixed factor.
    """
    views = [("image", lens, "") for lens in lenses]
    views += [("cubemap", "", f) for f in faces]
    views += [("perspective", "", f"y{y:+.0f}_p{p:+.0f}") for y, p in angles]
    views += [("split", lens, v) for lens in lenses if lens for v in splits]
    view = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("lens"), F.lit(v).alias("view")) for k, s, v in views])
    out = keyframes.withColumn("_v", F.explode(view)).select(*keyframes.columns, "_v.*")
    suffix = F.when(F.col("lens") != "", F.concat(F.lit("_"), F.col("lens"))).otherwise("")
    tail = F.when(F.col("view") != "", F.concat(F.lit("_"), F.col("view"))).otherwise("")
    name = F.concat(F.format_string(f"{prefix}_%06d", "frame_index"), suffix, tail, F.lit(f".{extension}"))
    folder = (
        F.when(F.col("kind") == "cubemap", F.concat(F.lit("cubemap/"), F.col("view"), F.lit("/")))
        .when(F.col("kind") == "perspective", F.concat(F.lit("perspective/"), F.col("view"), F.lit("/")))
        .when(F.col("kind") == "split", F.concat(F.lit("images/"), F.col("lens"), F.lit("_"), F.col("view"), F.lit("/")))
        .when(F.col("lens") != "", F.concat(F.lit("images/"), F.col("lens"), F.lit("/")))
        .otherwise("")
    )
    return out.withColumn("path", F.concat(folder, name))


def mask_path(path: str | Column, *, suffix: str = "_mask", extension: str | None = None, flatten: bool = False) -> Column:
    """Mask file that belongs to an image path below ``images/``."""
    p = F.col(path) if isinstance(path, str) else path
    rel = F.regexp_replace(p, "^images/", "")
    if flatten:
        rel = F.regexp_replace(rel, "^[LR]/", "")
    ext = "$2" if extension is None else "." + extension.lstrip(".")
    return F.concat(F.lit("masks/"), F.regexp_replace(rel, r"^(.*)(\.[^./]+)$", f"$1{suffix}{ext}"))
