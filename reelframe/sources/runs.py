"""Runs of named stages that are stored, found again and skipped.

A stage's table lies under a key: the hash of its name, version and parameters, of the keys of the tables it needs and
of the run's inputs. So a stored stage is reused exactly if nothing that it was made from has changed, whatever run wrote
it, and a changed parameter reruns the stage and what follows it. A stage counts once its marker is written, after the
table; the marker holds row count and schema, so a reused stage starts no job. Rows are counted while they are written.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelframe.sources.stages import safe_run_id

LOG_SCHEMA = "run_id string, seq bigint, event string, stage string, rows bigint, error string"
MARKER = "_COMMITTED"


@dataclass(frozen=True)
class Stage:
    """``build`` makes the stage's table from the tables it ``needs``: inputs of the run or earlier stages.

    ``params`` and ``version`` stand for everything else the result depends on; change ``version`` with the code.
    With ``ends_if_empty`` a table without rows ends the run.
    """

    name: str
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    needs: Sequence[str] = ()
    params: Mapping[str, object] = field(default_factory=dict)
    version: str = "1"
    ends_if_empty: bool = False


@dataclass(frozen=True)
class Input:
    """A table from outside and what identifies its content, for example :func:`files_fingerprint` of its path."""

    table: DataFrame
    fingerprint: str


@dataclass
class RunResult:
    """Tables by stage, stages that were computed and reused, row counts, and the stage that ended the run early."""

    tables: dict[str, DataFrame]
    computed: list[str]
    reused: list[str]
    rows: dict[str, int]
    ended_by: str | None = None


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    at, store = _path(spark, path)
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _get(spark: SparkSession, path: str) -> str | None:
    at, store = _path(spark, path)
    if not store.exists(at):
        return None
    source = store.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """Hash of the names, sizes and times of the files under ``path``; reads the listing only."""
    at, store = _path(spark, path)
    found = []
    listing = store.listFiles(at, True)
    while listing.hasNext():
        f = listing.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def stage_key(stage: Stage, upstream: Sequence[str]) -> str:
    """Hash of everything a stage's table is made from; ``upstream`` has the keys of what it needs, in order."""
    parts = [stage.name, stage.version, stage.params, list(upstream)]
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class RunStore:
    """Stored stages under ``root``, and the log of one run. ``root`` is a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), safe_run_id(run_id)
        self.seq = time.time_ns()

    def _at(self, stage: str, key: str) -> str:
        return f"{self.root}/stages/stage={stage}/key={key}"

    def find(self, stage: str, key: str) -> tuple[DataFrame, int] | None:
        """A committed table and its number of rows; an attempt without marker doesn't count."""
        text = _get(self.spark, f"{self._at(stage, key)}/{MARKER}")
        if text is None:
            return None
        mark = json.loads(text)
        table = self.spark.read.schema(StructType.fromJson(mark["schema"])).parquet(f"{self._at(stage, key)}/rows")
        return table, mark["rows"]

    def write(self, stage: str, key: str, table: DataFrame) -> tuple[DataFrame, int]:
        """Write a table, then its marker. A concurrent run of the same stage writes the same content."""
        seen = Observation()
        table.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self._at(stage, key)}/rows")
        rows = int(seen.get["rows"])
        _put(self.spark, f"{self._at(stage, key)}/{MARKER}", json.dumps({"rows": rows, "schema": table.schema.jsonValue()}))
        return self.find(stage, key)

    def log(self, event: str, stage: str | None = None, rows: int | None = None, error: str | None = None) -> None:
        self.seq += 1
        entry = {"run_id": self.run_id, "seq": self.seq, "event": event, "stage": stage, "rows": rows, "error": error}
        _put(self.spark, f"{self.root}/log/run_id={self.run_id}/{self.seq}.json", json.dumps(entry))

    def events(self) -> DataFrame:
        """The run's log, as ``run_manifest`` takes it."""
        return self.spark.read.schema(LOG_SCHEMA).json(f"{self.root}/log/run_id={self.run_id}")


def run_stages(store: RunStore, stages: Sequence[Stage], inputs: Mapping[str, Input], *, resume: bool = True) -> RunResult:
    """Run the stages in order. Stored ones are read with ``resume``; without it all are computed and stored again.

    A failing stage is logged with its error and raises; what was stored before stays and a later run takes it up.
    """
    tables = {name: i.table for name, i in inputs.items()}
    keys = {name: i.fingerprint for name, i in inputs.items()}
    result = RunResult({}, [], [], {})
    if resume:
        store.log("resumed")
    for stage in stages:
        keys[stage.name] = key = stage_key(stage, [keys[n] for n in stage.needs])
        found = store.find(stage.name, key) if resume else None
        if found is None:
            try:
                found = store.write(stage.name, key, stage.build({n: tables[n] for n in stage.needs}))
            except Exception as error:
                store.log("failed", stage.name, error=str(error)[:2000])
                raise
            result.computed.append(stage.name)
            store.log("done", stage.name, rows=found[1])
        else:
            result.reused.append(stage.name)
        tables[stage.name], result.rows[stage.name] = found
        result.tables[stage.name] = tables[stage.name]
        if stage.ends_if_empty and found[1] == 0:
            result.ended_by = stage.name
            break
    return result
