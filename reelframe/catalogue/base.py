"""Registry of queries: one column spec drives the Spark result and the SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.session import ship_package

DIGITS = 6
# Moves decimal ties such as 0.1234565 off the rounding border on both sides.
NUDGE = 1.7e-9


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return self.build(spark, sf_dir).select(*[_spark_column(n, t) for n, t in self.columns])

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_column(n, t) for n, t in self.columns)
        return f"SELECT {cols} FROM ({self.sql}) AS result"


QUERIES: dict[str, Query] = {}


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind == "d":
        return (F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(name)
    return c.cast({"l": "bigint", "s": "string", "b": "boolean"}[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "d":
        return f"round(CAST({name} AS DOUBLE) + {NUDGE}, {DIGITS}) + 0.0 AS {name}"
    return f"CAST({name} AS {dict(l='BIGINT', s='VARCHAR', b='BOOLEAN')[kind]}) AS {name}"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(spark, sf_dir)``; ``columns`` lists ``name:kind`` (l, d, s or b)."""
    spec = tuple((c.split(":")[0], c.split(":")[1]) for c in columns.split())

    def wrap(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, build, spec, sql)
        return build

    return wrap
