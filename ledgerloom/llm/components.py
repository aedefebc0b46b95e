"""Connected components of an edge table, by alternating star contractions.

Each round points every node's larger neighbours, then its smaller ones and itself, to the least
neighbour.  Rounds are written to the shared folder, so that lineage stays short and a lost executor
costs one round.  A hot node is aggregated before the shuffle, and the join back to it is one that
Spark splits; nothing but the check sum of a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its least node.

    Loops and null ends are ignored, repeated edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = materialise(spark, now, "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(lower, "a").select("b", "a", "least")
        now = materialise(
            spark,
            small.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(lower.select("a", F.col("least").alias("b")))
            .where("a <> b")
            .distinct(),
            "components",
        )
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if sums == seen:
            break
        seen = sums
    # Every edge now points from a node to its component's least node.
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
