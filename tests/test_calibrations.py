from reelframe.operators.calibrations import vo_runtime_status

NINE = [float(i) for i in range(9)]
FILES = "xml_path string, camera_matrix array<double>, dist array<double>, width long, height long, model string"
RUNS = "run string, layout string, vo_enabled boolean, projection string, mono_xml string, front_xml string, rear_xml string, lens int"


def files(spark):
    rows = [(x, NINE, [0.0], 4, 3, "opencv") for x in ("m", "f", "r", "f")]
    broken = [("short", NINE[:8], [0.0], 4, 3, "opencv"), ("text", NINE[:8] + [None], [0.0], 4, 3, "opencv"), ("bare", NINE, None, 4, 3, "opencv")]
    return spark.createDataFrame(rows + broken, FILES)


def status(spark, *runs):
    rows = vo_runtime_status(spark.createDataFrame([(*r, 1) for r in runs], RUNS), files(spark), ["run"]).collect()
    path = lambda c: c and c.xml_path
    return {r.run: (path(r.mono), path(r.front), path(r.rear), r.reason) for r in rows}


def test_lenses_fall_back_to_the_mono_calibration(spark):
    got = status(
        spark,
        ("single", None, True, None, "m", "f", "r"),
        ("own", "stereo", True, None, "m", "f", "r"),
        ("unnamed", "stereo", True, None, "m", " ", None),
        ("unusable", "stereo", True, "cubemap", "m", "short", "text"),
        ("two files", "front_rear", True, None, "m", "f", None),
        ("two unusable", "front_rear", True, None, "m", "bare", "gone"),
        ("rear only", "front_rear", None, None, None, None, "r"),
    )
    assert got == {
        "single": ("m", None, None, "enabled"),
        "own": ("m", "f", "r", "enabled"),
        "unnamed": ("m", "m", "m", "enabled"),
        "unusable": ("m", "m", "m", "enabled"),
        "two files": (None, "f", "m", "enabled"),
        "two unusable": (None, None, None, "calibration_unavailable"),
        "rear only": (None, None, "r", "calibration_unavailable"),
    }


def test_reasons_in_order_and_odd_rows(spark):
    got = status(
        spark,
        ("off", "stereo", False, "cubemap", None, None, None),
        ("view", "single", True, " Equirectangular", "m", None, None),
        ("view without file", "single", True, "cubemap", "gone", None, None),
        (None, "STEREO ", None, None, "m", None, None),
    )
    assert {k: v[3] for k, v in got.items()} == {
        "off": "vo_disabled_by_config",
        "view": "projection_mode_unsupported",
        "view without file": "calibration_unavailable",
        None: "enabled",
    }
    assert got[None][:3] == ("m", "m", "m")


def test_empty_tables(spark):
    none = spark.createDataFrame([], RUNS)
    assert vo_runtime_status(none, files(spark), ["run"]).collect() == []
    run = spark.createDataFrame([("a", "stereo", True, None, "m", None, None, 1)], RUNS)
    row = vo_runtime_status(run, files(spark).limit(0), ["run"]).first()
    assert (row.reason, row.enabled, row.calibration_loaded) == ("calibration_unavailable", False, False)
