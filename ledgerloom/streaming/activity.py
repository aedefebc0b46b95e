"""Append-only audit feed as a stream from table to table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stream_activity(source: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append audit rows as they arrive; the feed itself is read newest first."""
    writer = source.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
