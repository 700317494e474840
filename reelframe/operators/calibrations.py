"""Calibrations of runs with their fallbacks, and whether odometry can run.

``runs`` names files (mono_xml, front_xml, rear_xml) and a layout: ``front_rear`` has two lenses with a file each,
``stereo`` two lenses that share the mono calibration where their own is missing or unusable, anything else one lens.
``calibrations`` is what ``sources.calibration.calibration_scan`` returns; a file is usable if its matrix has nine
numbers and its distortion has only numbers. Of repeated rows of a file the smallest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelframe.functions import scores as S

LENSES = ("mono", "front", "rear")
FRONT_REAR, STEREO = "front_rear", "stereo"


def _layout() -> Column:
    return F.lower(F.trim(F.coalesce(F.col("layout"), F.lit(""))))


def _paths() -> dict[str, Column]:
    """The file each lens reads, null if none: lenses without a file name read the mono file."""
    named = {lens: F.nullif(F.trim(F.col(f"{lens}_xml")), F.lit("")) for lens in LENSES}
    paired = _layout().isin(FRONT_REAR, STEREO)
    return {
        "mono": F.when(_layout() != FRONT_REAR, named["mono"]),
        "front": F.when(paired, F.coalesce(named["front"], named["mono"])),
        "rear": F.when(paired, F.coalesce(named["rear"], named["mono"])),
    }


def usable(calibrations: DataFrame) -> DataFrame:
    """(xml_path, calibration) of the files that hold a 3 x 3 matrix and only numbers."""
    numbers = lambda c: F.forall(c, lambda x: x.isNotNull())
    whole = (F.size("camera_matrix") == 9) & numbers("camera_matrix") & F.coalesce(numbers("dist"), F.lit(False))
    return calibrations.where(whole).select("xml_path", F.struct("xml_path", "camera_matrix", "dist", "width", "height", "model").alias("calibration"))


def resolve_calibrations(runs: DataFrame, calibrations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``runs`` (one row per ``keys``) with structs mono, front and rear, null where none can be used.

    Only lenses with a file name are joined, so runs without files don't meet on a null key.
    """
    paths = _paths()
    wanted = runs.select(*keys, F.explode(F.create_map(*(c for lens in LENSES for c in (F.lit(lens), paths[lens])))).alias("lens", "xml_path"))
    found = wanted.where("xml_path IS NOT NULL").join(usable(calibrations), "xml_path")
    per_run = found.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
        *(F.min(F.when(F.col("lens") == lens, F.col("calibration"))).alias(lens) for lens in LENSES)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = runs.join(per_run, same, "left").drop(*(f"_{k}" for k in keys))
    shared = F.when(_layout() == STEREO, F.col("mono"))
    return out.withColumns({lens: F.coalesce(F.col(lens), shared) for lens in ("front", "rear")})


def vo_runtime_status(runs: DataFrame, calibrations: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``resolve_calibrations`` with enabled, reason and calibration_loaded.

    ``runs`` also has vo_enabled (null means on) and projection. Paired runs use the front calibration, else the mono one.
    """
    out = resolve_calibrations(runs, calibrations, keys)
    paired = _layout().isin(FRONT_REAR, STEREO)
    calibrated = F.when(paired, F.coalesce("front", "mono")).otherwise(F.col("mono")).isNotNull()
    on = F.coalesce(F.col("vo_enabled"), F.lit(True))
    reason = S.vo_runtime_reason(on, calibrated, F.col("projection"), paired)
    return out.withColumns({"reason": reason, "enabled": reason == S.ENABLED, "calibration_loaded": on & calibrated})
