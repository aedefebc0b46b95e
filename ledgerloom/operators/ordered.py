"""Running sums in a total order, without ordering a key in one task.

Rows are dealt by range of (keys, order) and written once, so that every reader sees the same ranges.  A range
knows what the earlier ranges of its key hold; rows are ordered only inside their range.  However many rows one key
has, however many of them share a moment, the tasks get about equal parts, because the order goes down to a key
that differs from row to row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def dealt_by_range(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in a written table, with the number of their range in ``_range``."""
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    return materialise(rows.sparkSession, dealt, "ranges")


def earlier_total(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the same keys.

    ``order`` must be total inside a key; null keys are a key of their own.
    """
    columns = rows.columns
    dealt = dealt_by_range(rows.withColumn("_value", value), keys, order)
    totals = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_total"))
    # As many rows as ranges, or fewer, for each key.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    slots = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    offsets = totals.select(*slots, F.col("_range").alias("_of"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_within", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return within.join(offsets, same).select(*columns, (F.col("_before") + F.col("_within")).alias(name))
