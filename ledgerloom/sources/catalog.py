"""Stored tables that are read only through the tenant they belong to.

Every table is a folder of Parquet files by ``tenant_id`` and, where asked, more partition columns.  A reader
gets tables from a ``Scope``; its tenant is part of the scan (a partition filter), so another tenant's files are
not opened.  A scope without tenant sees and writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TENANT = "tenant_id"


class Catalog:
    """Tables under one folder, all of them partitioned by tenant first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str, rows: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
        """Write a whole table; files are ranges of ``order`` inside their partition.

        The columns are kept beside it, so that partition values are read with their own type and an empty
        table can be read too.
        """
        rows.limit(0).write.mode("overwrite").parquet(self.path(f"{name}.columns"))
        self._laid(rows, by, order).write.mode("overwrite").partitionBy(TENANT, *by).parquet(self.path(name))

    @staticmethod
    def _laid(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
        keys = [F.col(c) for c in (TENANT, *by, *order)]
        # A range shuffle splits a large tenant over many tasks and keeps each file's values close together.
        return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def replace_partitions(self, name: str, rows: DataFrame, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
        """Overwrite only the partitions that ``rows`` has rows of.

        ``rows`` may read this table: a dynamic overwrite puts its files in place when all of them are written.
        """
        to = self._laid(rows, by, order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        to.partitionBy(TENANT, *by).parquet(self.path(name))

    def columns(self, name: str) -> T.StructType:
        return self.spark.read.parquet(self.path(f"{name}.columns")).schema

    def system(self, name: str) -> DataFrame:
        """All tenants' rows, for upkeep jobs only."""
        return self.spark.read.schema(self.columns(name)).parquet(self.path(name))

    def scope(self, tenant: str | None) -> Scope:
        return Scope(self, tenant)


@dataclass(frozen=True)
class Scope:
    """One tenant's view of a catalog."""

    catalog: Catalog
    tenant: str | None

    @property
    def mine(self) -> Column:
        return F.col(TENANT) == F.lit(self.tenant) if self.tenant else F.lit(False)

    def table(self, name: str) -> DataFrame:
        return self.catalog.system(name).where(self.mine)

    def own(self, ids: DataFrame, name: str = "documents", key: str = "id") -> DataFrame:
        """Those of the given ids that are the tenant's; foreign ids fall away."""
        return ids.join(self.table(name).select(F.col(key).alias("id")), "id", "left_semi")

    def append(self, name: str, rows: DataFrame, by: tuple[str, ...] = ()) -> None:
        """Add rows to a table; whatever tenant they name, only the scope's own are written."""
        rows.where(self.mine).write.mode("append").partitionBy(TENANT, *by).parquet(self.catalog.path(name))
