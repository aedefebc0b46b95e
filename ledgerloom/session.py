"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators rely on.  Parallelism and memory stay with the cluster.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Later map entries overwrite earlier ones (shallow JSON merge).
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


#: Folders of local applications whose session names no shared root.
_LOCAL_ROOTS: dict[str, str] = {}

#: Parts into which a table is dealt before work that is heavy per row (see ``Archive.wide``).
WIDE_PARTITIONS = "spark.ledgerloom.widePartitions"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a session made elsewhere."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "ledgerloom") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        # Small test tables are split over the cores.
        .config("spark.sql.files.minPartitionNum", cores if cores.isdigit() else "8")
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The test tables are single row groups, which no scan splits.
        .config(WIDE_PARTITIONS, cores if cores.isdigit() else "8")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for written intermediate tables and stream state.

    The cluster names the shared root in ``spark.checkpoint.dir``.  Only where it
    names none and the master is local (tests) a temporary folder is used; anywhere
    else executors would not see each other's files, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # The setting cannot be changed on a running session, so the folder is kept here, one per application.
        application = spark.sparkContext.applicationId
        if application not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[application] = tempfile.mkdtemp(prefix="ledgerloom-")
        root = _LOCAL_ROOTS[application]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df, purpose: str):
    """Write ``df`` once to the shared folder and read it back (cuts lineage)."""
    path = shared_folder(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

