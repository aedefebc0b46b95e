"""Checksums of everything stored, by prefix, so that a batch reads only its own part of the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a prefix: 256 folders, of which a batch opens those of its own checksums.
PREFIX_DIGITS = 2
_SCHEMA = "tenant_id string, checksum string, id bigint, prefix string, batch_id bigint"


def prefix_of(checksum: Column) -> Column:
    return F.coalesce(F.substring(checksum, 1, PREFIX_DIGITS), F.lit("none"))


class ChecksumStore:
    """(tenant_id, checksum, id) in folders by prefix and batch; a repeated batch replaces its own rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self) -> None:
        """An empty store, if there is none (nothing is overwritten)."""
        empty = self.spark.createDataFrame([], _SCHEMA)
        empty.write.mode("append").partitionBy("prefix", "batch_id").parquet(self.path)

    def known(self, keys: DataFrame, before: int) -> DataFrame:
        """Checksums stored by batches before the given one that share a prefix with ``keys``.

        The prefixes are few by construction, so they can be part of the scan.
        """
        prefixes = [r["prefix"] for r in keys.select(prefix_of(F.col("checksum")).alias("prefix")).distinct().collect()]
        stored = self.spark.read.schema(_SCHEMA).parquet(self.path)
        mine = F.col("prefix").isin(*prefixes) if prefixes else F.lit(False)
        return stored.where(mine & (F.col("batch_id") < before)).select("tenant_id", "checksum")

    def add(self, files: DataFrame, batch_id: int) -> None:
        rows = files.select("tenant_id", "checksum", "id", prefix_of(F.col("checksum")).alias("prefix"), F.lit(batch_id).cast("bigint").alias("batch_id"))
        to = rows.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        to.partitionBy("prefix", "batch_id").parquet(self.path)
