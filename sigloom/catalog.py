"""Registered queries of the observability engine, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sigloom import session


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(session.prepare(spark), sf_dir)


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = Query(build, sql)
        return build

    return add
