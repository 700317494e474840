"""Camera calibration files of two XML layouts as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MATRIX = "struct<data:string>"
_MODELS = ("opencv", "fisheye")


def _hint(hint: str, derived):
    h = (hint or "auto").strip().lower()
    if h in _MODELS:
        return F.lit(h)
    return derived if h == "auto" else F.lit("opencv")


def opencv_calibration(spark: SparkSession, path: str, *, model: str = "auto") -> DataFrame:
    """Storage layout: matrix and distortion as number lists; four terms mean fisheye."""
    raw = (
        spark.read.format("xml")
        .option("rowTag", "opencv_storage")
        .schema(f"image_Width bigint, image_Height bigint, Camera_Matrix {_MATRIX}, Distortion_Coefficients {_MATRIX}")
        .load(path)
    )
    numbers = lambda c: F.transform(F.split(F.trim(F.col(c)), r"\s+"), lambda x: x.try_cast("double"))
    out = raw.select(
        F.col("_metadata.file_path").alias("xml_path"),
        numbers("Camera_Matrix.data").alias("camera_matrix"),
        numbers("Distortion_Coefficients.data").alias("dist"),
        F.coalesce("image_Width", F.lit(0)).alias("width"),
        F.coalesce("image_Height", F.lit(0)).alias("height"),
    ).filter("camera_matrix IS NOT NULL AND dist IS NOT NULL")
    derived = F.when(F.size("dist") == 4, "fisheye").otherwise("opencv")
    return out.withColumn("model", _hint(model, derived))


# Numeric fields of the second layout, all 0 when absent.
_TERMS = ("cx", "cy", "b1", "b2", "k1", "k2", "k3", "k4", "p1", "p2")


def agisoft_calibration(spark: SparkSession, path: str, *, model: str = "auto") -> DataFrame:
    """Photogrammetry layout: focal length with offsets from the image centre."""
    fields = "projection string, width bigint, height bigint, f double, " + ", ".join(f"{t} double" for t in _TERMS)
    raw = spark.read.format("xml").option("rowTag", "calibration").schema(fields).load(path)
    raw = raw.withColumn("xml_path", F.col("_metadata.file_path")).filter("width > 0 AND height > 0 AND f IS NOT NULL")
    raw = raw.fillna(0.0, list(_TERMS))
    c, zero, one = F.col, F.lit(0.0), F.lit(1.0)
    matrix = F.array(
        c("f") + c("b1"), c("b2"), c("width") * 0.5 + c("cx"), zero, c("f"), c("height") * 0.5 + c("cy"), zero, zero, one
    )
    h = (model or "auto").strip().lower()
    derived = F.when(F.contains(F.lower("projection"), F.lit("fisheye")), "fisheye").otherwise("opencv")
    kind = F.lit(h) if h in _MODELS else derived
    dist = F.when(kind == "fisheye", F.array("k1", "k2", "k3", "k4")).otherwise(F.array("k1", "k2", "p1", "p2", "k3"))
    return raw.select(
        "xml_path", matrix.alias("camera_matrix"), dist.alias("dist"), "width", "height", kind.alias("model")
    )


def calibration_scan(spark: SparkSession, path: str, *, model: str = "auto") -> DataFrame:
    """All calibration files below ``path``; each layout contributes the files it can read."""
    return opencv_calibration(spark, path, model=model).unionByName(agisoft_calibration(spark, path, model=model))
