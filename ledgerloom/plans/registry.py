"""Name -> query registry shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import WIDE_PARTITIONS, configure
from ..sources.archive import Archive, duckdb_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(archive)`` under ``name``; ``sql`` is the checking SQL.

    ``views`` lists the archive tables the checking SQL refers to.
    """

    def wrap(fn: Callable[[Archive], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            parts = spark.conf.get(WIDE_PARTITIONS, None)
            return fn(Archive(configure(spark), folder, int(parts) if parts else None))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = duckdb_with(views.split(), sql)
        return fn

    return wrap
