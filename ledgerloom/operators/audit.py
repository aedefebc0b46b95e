"""The audit log: append-only, each event once however often its task or batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What makes an event; the same change at the same moment is the same event.
IDENTITY = ("tenant_id", "type", "document_id", "user_id", "user_name", "happened_at", "meta")
_NULL = "\u0001"


def with_event_id(events: DataFrame) -> DataFrame:
    """Add ``event_id``, a digest of what makes the event."""
    parts = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\\\\\u0002]", r"\\$0"), F.lit(_NULL)) for c in IDENTITY]
    return events.withColumn("event_id", F.sha2(F.concat_ws("\u0002", *parts), 256))


class AuditLog:
    """Events in one folder per batch and tenant."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame, batch: str) -> None:
        """Write a batch of events; the batch run again replaces itself."""
        rows = with_event_id(events).withColumn("batch", F.lit(batch))
        to = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        to.partitionBy("batch", "tenant_id").parquet(self.path)

    def read(self, columns: DataFrame) -> DataFrame:
        """Every event once, also if two batches report it; ``columns`` has the columns of the events."""
        fields = ", ".join(f"`{n}` {t}" for n, t in columns.dtypes)
        stored = self.spark.read.schema(f"{fields}, event_id string, batch string").parquet(self.path)
        # Events are told apart by the bytes of the digest, half as long as its digits.
        return stored.drop("batch").withColumn("_digest", F.unhex("event_id")).dropDuplicates(["_digest"]).drop("_digest")
