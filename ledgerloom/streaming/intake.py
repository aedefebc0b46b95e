"""Continuous intake: one job per micro-batch, from new rows to documents, queue, audit rows and index.

A batch is staged once, so every step sees the same rows.  Its checksums are compared with those of earlier
batches (only the prefixes that occur in the batch are read); new documents are extracted, scored and routed.
Which rows are new is kept as a bit per staged row, so texts are read where they lie and not shuffled.  The staged
rows go when their documents are processed.  All tables are written under the batch's number:

* ``path``: documents, ``batch_id=N``;
* ``path.state/queue``: documents that wait for the model, with the mode of the call;
* ``path.state/audit``: an upload and a processing event per document;
* ``path.state/checksums``: by prefix and batch;
* the search index, if one is given: version N + 1.

Each of them replaces what an earlier run of the same batch has written and nothing else, so a batch that runs
again after a lost executor or driver leaves the same tables.  There is no watermark and no growing state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import AuditLog
from ..operators.extract import extract_candidates, model_input_mode
from ..operators.gate import score_candidates
from ..operators.joins import fresh_places
from ..operators.routing import decide
from ..operators.search_index import SearchIndex
from ..session import materialise
from ..sources.checksums import ChecksumStore

OUTPUT = (
    "tenant_id", "checksum", "id", "mime_type", "document_type", "vendor", "invoice_number", "total_amount", "gate_score", "gate_passed",
    "status", "extraction_status", "extraction_method",
)

#: What a source may leave out, and the value it then has.
DEFAULTS = {
    "mime_type": "'application/pdf'", "title": "CAST(NULL AS STRING)", "original_filename": "CAST(NULL AS STRING)",
    "ocr_confidence": "CAST(NULL AS DOUBLE)", "has_text_layer": "true", "uploaded_at": "CAST(NULL AS TIMESTAMP_NTZ)",
}


@dataclass
class Job:
    """Where a stream writes, and what its steps need besides the documents."""

    path: str
    #: (tenant_id, allowed): may the tenant's documents go to the model; without it all may.
    allowed: DataFrame | None = None
    index: SearchIndex | None = None

    @property
    def state(self) -> str:
        return f"{self.path.rstrip('/')}.state"


def process_documents(docs: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Extract, score and route new documents; answers of the model are not there yet."""
    scored = score_candidates(extract_candidates(docs))
    none = {"model_type": "string", "model_confidence": "double", "model_fields": "string"}
    joined = scored.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    if allowed is None:
        joined = joined.withColumn("admitted", F.lit(True))
    else:
        joined = joined.join(allowed.select("tenant_id", F.col("allowed").alias("admitted")), "tenant_id", "left")
    return decide(joined)


#: Rows of a staged file and of a block of bits.
BLOCK = 32768


def _put(rows: DataFrame, path: str) -> None:
    # Digests in hexadecimal are a large part of the bytes; zstd halves them and snappy keeps them.
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _staged(batch: DataFrame, path: str) -> DataFrame:
    """The batch as a table of its own, with checksums and a place that differs from row to row."""
    filled = batch.select("*", *[F.expr(e).alias(c) for c, e in DEFAULTS.items() if c not in batch.columns])
    # Small files share the work on them out evenly.
    to = filled.withColumn("checksum", F.sha2("text", 256)).write.mode("overwrite").option("maxRecordsPerFile", BLOCK)
    to.option("compression", "zstd").parquet(path)
    place = F.struct(F.col("id"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return batch.sparkSession.read.parquet(path).withColumn("idx", place)


def _fresh(staged: DataFrame, known: DataFrame, path: str) -> DataFrame:
    """The staged rows that ``ingest_dedup`` keeps.

    The keys and places are shuffled (checksums as bytes); what they say is stored as one bit per staged row, a block
    of bits per file, small enough to be joined to the rows where they lie.
    """
    digest = F.unhex("checksum").alias("checksum")
    places = fresh_places(staged.select("tenant_id", digest, "idx"), known.select("tenant_id", digest))
    number = F.col("idx.row") + 1  # Spark's bitmaps count from 1
    block = (F.col("idx.file").alias("_file"), F.bitmap_bucket_number(number).alias("_block"))
    bits = places.groupBy(*block).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    _put(bits, path)
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
    marked = staged.withColumns({"_file": block[0], "_block": block[1]})
    return marked.join(staged.sparkSession.read.parquet(path), ["_file", "_block"]).where(is_set).drop("_file", "_block", "_bits")


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def batch_writer(path: str, allowed: DataFrame | None = None, index: SearchIndex | None = None) -> Callable[[DataFrame, int], None]:
    """The per-batch job; input rows have id, tenant_id, text and what of ``DEFAULTS`` the source knows."""
    job = Job(path, allowed, index)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stage = f"{job.state}/staged/batch_id={batch_id}"
        staged = _staged(batch, stage)
        store = ChecksumStore(spark, f"{job.state}/checksums")
        store.create()
        fresh = _fresh(staged, store.known(staged, batch_id), f"{job.state}/fresh/batch_id={batch_id}")
        # A row per tenant: written first, its size is known when the join is planned, and the texts need not move for it.
        may = None if job.allowed is None else materialise(spark, job.allowed.select("tenant_id", "allowed"), "allowed")
        done = f"{job.state}/processed/batch_id={batch_id}"
        _put(process_documents(fresh, may).withColumn("mode", model_input_mode()).drop("idx", "text"), done)
        processed = spark.read.parquet(done)
        if job.index is not None:
            job.index.apply(batch_id + 1, fresh.select("tenant_id", "id", "title", "original_filename", "text"))
        _removed(spark, stage)

        queue = processed.where("queued AND extraction_status <> 'skipped_budget'")
        _put(queue.select("id", "tenant_id", "mode"), f"{job.state}/queue/batch_id={batch_id}")
        AuditLog(spark, f"{job.state}/audit").append(_events(processed), f"{batch_id:020d}")
        store.add(processed, batch_id)
        # The documents come last: a reader that sees a batch sees all of it.
        _put(processed.select(*OUTPUT), f"{path}/batch_id={batch_id}")

    return write


def _events(processed: DataFrame) -> DataFrame:
    """An upload and the end of processing, one row each per document."""
    def event(kind: str, meta) -> DataFrame:
        return processed.select(
            "tenant_id", F.lit(kind).alias("type"), F.col("id").alias("document_id"), F.col("original_filename").alias("document_name"),
            F.lit(None).cast("bigint").alias("user_id"), F.lit("system").alias("user_name"), F.col("uploaded_at").alias("happened_at"), meta.alias("meta"),
        )

    return event("upload", F.lit(None).cast("string")).unionByName(event("processing_complete", F.concat_ws("/", "status", "extraction_status")))


def stream_ingest(
    source: DataFrame, path: str, checkpoint: str, once: bool = True, allowed: DataFrame | None = None, index: SearchIndex | None = None
):
    """Start the intake stream.  ``once`` handles what is there and then stops."""
    writer = source.writeStream.foreachBatch(batch_writer(path, allowed, index)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
