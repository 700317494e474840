"""Registered queries of the subpackage; SQL where DuckDB can express the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from reelframe.session import ship_package


@dataclass(frozen=True)
class LlmQuery:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return self.build(spark, sf_dir)


QUERIES: dict[str, LlmQuery] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = LlmQuery(build, sql)
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
