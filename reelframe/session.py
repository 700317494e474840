"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(cpus: str | int = "*", app: str = "reelframe") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(session)  # workers may start in any folder
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Functions that run inside tasks import it, whatever folder the driver started in.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / package.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="spark-reelframe-")
    return _LOCAL_ROOTS[app]


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cached frame it survives lost executors, and unlike a checkpoint it
    keeps column pruning and filter pushdown for the readers.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/reelframe-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> None:
    """Delete every table this application wrote with :func:`written_table`."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(
        f"{scratch_root(spark)}/reelframe-{spark.sparkContext.applicationId}"
    )
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
