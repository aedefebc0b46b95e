"""File intake, invoice XML, exports and streams (A, K16, K17)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import filters as flt
from ..operators import maintain as mt
from ..operators import spreadsheet as sh
from ..operators.audit import AuditLog
from ..session import shared_folder
from ..sources import exports as xp
from ..sources import files as fl
from ..sources.archive import Archive
from ..streaming.activity import stream_activity
from ..streaming.intake import stream_ingest
from .extraction import GATE
from .registry import query

STREAM_SECONDS = 1800

# -- files ---------------------------------------------------------------------------

query("a01_ingest_files")(lambda a: _ingested(a))


def _ingested(a: Archive):
    """Every document as a file: a row for each accepted and each rejected one."""
    out = fl.ingest_rows(_upload(a).withColumn("path", F.col("filename")), "t1")
    fresh = out["documents"].withColumnRenamed("original_filename", "filename")
    kept = fresh.select("filename", "size_bytes", "id", "mime_type", "checksum", "status", F.lit(None).cast("string").alias("reject_reason"))
    return kept.unionByName(out["rejected"].select("filename", "size_bytes", "reject_reason"), allowMissingColumns=True)


def _upload(a: Archive):
    """Every document as file bytes, in turn as the known kinds of content."""
    turn = F.col("doc_id") % 12
    text = F.encode("text", "UTF-8")
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    put = lambda b: F.concat(F.lit(b), text)
    content = (
        F.when(turn == 0, put(b"%PDF-1.7 "))
        .when(turn == 1, put(b"\x89PNG\r\n\x1a\n"))
        .when(turn == 2, put(b"\xff\xd8\xff"))
        .when(turn == 3, put(b"RIFF1234WEBP"))
        .when(turn == 4, put(b"MM\x00*"))
        .when(turn == 5, put(b"PK\x03\x04"))
        .when(turn == 6, put(b"From: a@b.c\r\nSubject: x\r\n\r\n"))
        .when(turn == 7, put(b" \n<?xml version='1.0'?>"))
        .when(turn == 8, F.concat(F.lit(b"\x80\x81\x00\x02"), text))
        .when(turn == 9, F.concat(F.lit("é".encode("latin-1")), latin))
        .otherwise(text)
    )
    ext = F.when(turn == 10, ".CSV").when(turn == 11, ".md").otherwise(".bin")
    return a.wide("documents").select(
        "doc_id",
        (F.col("doc_id") % 37).alias("batch_id"),
        F.concat(F.col("doc_id"), ext).alias("filename"),
        content.alias("content"),
    ).withColumn("size_bytes", F.length("content").cast("bigint"))


_MIMES = """CASE doc_id % 12 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/tiff'
WHEN 5 THEN NULL WHEN 6 THEN 'message/rfc822' WHEN 7 THEN 'application/xml' WHEN 8 THEN NULL WHEN 9 THEN 'text/plain' WHEN 10 THEN 'text/csv' ELSE 'text/markdown' END"""
_EXTS = """CASE doc_id % 12 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'webp' WHEN 4 THEN 'tif' WHEN 6 THEN 'eml' WHEN 7 THEN 'xml' WHEN 9 THEN 'txt' WHEN 10 THEN 'csv' WHEN 11 THEN 'md' END"""

query("a02_classify_content", "", f"SELECT doc_id, {_MIMES} AS mime_type FROM documents")(
    lambda a: fl.classify_content(_upload(a)).select("doc_id", "mime_type")
)

query(
    "a03_accept_or_reject",
    "",
    f"SELECT doc_id, {_EXTS} AS ext, CASE WHEN {_EXTS} IS NULL THEN 'unsupported_type' END AS reject_reason FROM documents",
)(lambda a: fl.check_files(fl.classify_content(_upload(a))).select("doc_id", "ext", "reject_reason"))

query(
    "a04_max_size_filter",
    "archive",
    """SELECT id, CASE WHEN size_bytes * 500 > 50 * 1024 * 1024 THEN 'too_large' WHEN mime_type IS NULL THEN 'unsupported_type' END AS reject_reason FROM archive""",
)(
    lambda a: fl.check_files(a.table("archive").withColumn("size_bytes", F.col("size_bytes") * 500)).select("id", "reject_reason")
)

query(
    "a05_batch_count_cap",
    "archive",
    """SELECT id FROM archive WHERE uploaded_by NOT IN (SELECT uploaded_by FROM archive GROUP BY 1 HAVING count(*) > 50)
AND NOT (tenant_id = 't1') UNION ALL SELECT id FROM archive WHERE tenant_id = 't1' AND (SELECT count(*) FROM archive WHERE tenant_id = 't1') <= 50""",
)(
    lambda a: fl.batch_count_cap(
        a.table("archive").select(
            "id", F.when(F.col("tenant_id") == "t1", "t1").otherwise(F.col("uploaded_by").cast("string")).alias("batch_id")
        )
    ).select("id")
)

query("a06_read_plain_text", "", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') AS decoded FROM documents")(
    lambda a: a.wide("documents").select(
        "doc_id",
        fl.decode_text(F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")).alias("decoded"),
    )
)

_LINES = """(SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS s,
  sum(CAST(l_quantity AS INT)) AS q, min('Part ' || l_partkey) AS d FROM lineitem GROUP BY 1)"""
query(
    "a07_read_ubl_invoices",
    "",
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Legal ' ELSE 'Trade ' END || o_custkey AS vendor, 'INV-' || o_orderkey AS invoice_number,
  CAST(o_orderdate AS DATE) AS invoice_date, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate + INTERVAL '30' DAY AS DATE) END AS due_date,
  CAST(o_totalprice AS DECIMAL(12,2))::DOUBLE AS total_amount, 'MYR' AS currency, n AS n_items, s::DOUBLE AS items_total, q::DOUBLE AS quantity, d AS first_description
FROM orders JOIN {_LINES} ON l_orderkey = o_orderkey WHERE o_orderkey % 11 > 2""",
)(lambda a: _ubl(a))


def _ubl(a: Archive):
    total = lambda part: F.aggregate(
        F.filter(F.transform("line_items", lambda i: i[part].cast("decimal(14,2)")), lambda x: x.isNotNull()),
        F.lit(0).cast("decimal(24,2)"),
        lambda s, x: (s + x).cast("decimal(24,2)"),
    )
    some = F.exists("line_items", lambda i: i["amount"].isNotNull())
    return fl.read_ubl_invoices(a.table("ubl", heavy=True)).select(
        "id", "vendor", "invoice_number", "invoice_date", "due_date", "total_amount", "currency",
        F.size("line_items").cast("bigint").alias("n_items"),
        F.when(some, total("amount").cast("double")).alias("items_total"),
        total("quantity").cast("double").alias("quantity"),
        F.array_min(F.transform("line_items", lambda i: i["description"])).alias("first_description"),
    )


query(
    "a08_flatten_xml_text",
    "ubl",
    """SELECT id, CASE WHEN id % 11 IN (0, 1) THEN '' ELSE trim(regexp_replace(regexp_replace(regexp_replace(xml, '<\\?[^>]*>', ''), '\\s*<[^>]*>\\s*', '  ', 'g'), '\\s\\s+', ' ', 'g')) END AS xml_text FROM ubl""",
)(lambda a: fl.flatten_xml_text(a.table("ubl", heavy=True)).select("id", "xml_text"))

# -- exports --------------------------------------------------------------------------

_EXPORT_SQL = """SELECT coalesce(nullif(title, ''), original_filename) AS "Title", vendor AS "Vendor", invoice_no AS "Invoice No", CAST(total_amount AS VARCHAR) AS "Total Amount",
  currency AS "Currency", document_type AS "Document Type", status AS "Status", CAST(document_date AS VARCHAR) AS "Document Date",
  strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S+00:00') AS "Uploaded At" FROM archive WHERE deleted_at IS NULL AND status = 'completed'"""


@query("a09_export_csv", "archive", _EXPORT_SQL)
def a09(a: Archive):
    rows = xp.export_rows(flt.apply_filter(a.table("archive"), flt.DocumentFilter(status="completed")), limit=None)
    path = shared_folder(a.spark, "export")
    xp.write_csv(rows, path, mark=False)
    # Empty cells come back as NULL.
    return a.spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query(
    "a10_export_spreadsheet_csv",
    "archive",
    """SELECT id::VARCHAR AS id, original_filename AS filename, CASE WHEN extracted_data ->> '$.po_ref' <> '' THEN extracted_data ->> '$.po_ref' END AS po_ref
FROM archive WHERE deleted_at IS NULL AND extracted_data IS NOT NULL""",
)
def a10(a: Archive):
    rows = sh.summary_rows(flt.apply_filter(a.table("archive"), flt.DocumentFilter(has_data=True)), ["po_ref"]).select(
        "id", "filename", "po_ref"
    )
    path = shared_folder(a.spark, "sheet")
    xp.export_spreadsheet_csv(rows, path)
    text = xp.spreadsheet_csv_rows(rows)
    return a.spark.read.schema(text.schema).option("header", True).option("escape", '"').csv(path)


# -- streams ----------------------------------------------------------------------------


def _stream(a: Archive, name: str):
    source = a.spark.readStream.schema(a.parquet(name).schema).option("pathGlobFilter", f"{name}.parquet")
    return source.parquet(a.folder)


# Rendered invoices and plain documents arrive as one stream of files.
_JOB = f"""{GATE}, ok AS (SELECT t.tenant_id, coalesce(t.llm_monthly_token_cap, 2000000) > 0 AND coalesce(u.u, 0) < coalesce(t.llm_monthly_token_cap, 2000000) AS allowed
  FROM tenants t LEFT JOIN (SELECT tenant_id, sum(total_tokens) AS u FROM ai_usage WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1) u USING (tenant_id)),
fresh AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY tenant_id, sha256(text) ORDER BY id) = 1),
d AS (SELECT f.*, s.id IS NOT NULL AS is_candidate, t.document_type, s.gate_score, coalesce(s.gate_passed, false) AS passed, coalesce(ok.allowed, false) AS allowed,
  f.mime_type IN ('application/pdf', 'image/png', 'application/xml') AND s.id IS NOT NULL AS attempted
  FROM (SELECT *, sha256(text) AS checksum FROM fresh) f LEFT JOIN scored s ON s.id = f.id LEFT JOIN typed t ON t.id = f.id LEFT JOIN ok ON ok.tenant_id = f.tenant_id),
e AS (SELECT *, attempted AND NOT passed AND mime_type <> 'application/xml' AS queued FROM d),
docs AS (SELECT tenant_id, id, checksum, document_type, gate_score, text, has_text_layer, queued, allowed, CASE WHEN attempted AND NOT passed THEN 'needs_review' ELSE 'completed' END AS status,
  CASE WHEN NOT attempted THEN 'none' WHEN passed THEN 'accepted' WHEN queued AND NOT allowed THEN 'skipped_budget' ELSE 'low_confidence' END AS extraction_status,
  CASE WHEN attempted AND NOT queued THEN 'deterministic' WHEN queued THEN 'vlm' END AS extraction_method FROM e)"""


def _run_intake(a: Archive, index=None) -> str:
    folder = shared_folder(a.spark, "arrivals")
    a.table("corpus", heavy=True).withColumn("original_filename", F.concat(F.col("title"), F.lit(".txt"))).write.option("compression", "zstd").parquet(folder)
    rows = a.spark.readStream.schema(a.spark.read.parquet(folder).schema).parquet(folder)
    allowed = agg.budget_allowed(a.table("tenants"), a.table("ai_usage"), datetime.datetime(2024, 1, 31))
    path = shared_folder(a.spark, "intake")
    run = stream_ingest(rows, path, shared_folder(a.spark, "intake-progress"), allowed=allowed, index=index)
    if not run.awaitTermination(STREAM_SECONDS):
        run.stop()
        raise TimeoutError("the intake stream did not finish")
    return path


@query(
    "k16_stream_ingest",
    "corpus tenants ai_usage",
    f"""{_JOB} SELECT tenant_id, checksum, id, document_type, gate_score, status, extraction_status, extraction_method,
  CASE WHEN queued AND allowed THEN CASE WHEN has_text_layer AND length(trim(text)) >= 8 THEN 'text' ELSE 'vision' END END AS queue_mode FROM docs""",
)
def k16(a: Archive):
    path = _run_intake(a)
    columns = ["tenant_id", "checksum", "id", "document_type", "gate_score", "status", "extraction_status", "extraction_method"]
    queue = a.spark.read.parquet(f"{path}.state/queue").select("id", F.col("mode").alias("queue_mode"))
    return a.spark.read.parquet(path).select(*columns).join(queue, "id", "left").select(*columns, "queue_mode")


@query(
    "k16_stream_audit",
    "corpus tenants ai_usage",
    f"""{_JOB} SELECT tenant_id, id AS document_id, 'upload' AS type, NULL AS meta FROM docs
UNION ALL SELECT tenant_id, id, 'processing_complete', status || '/' || extraction_status FROM docs""",
)
def k16_audit(a: Archive):
    path = _run_intake(a)
    log = AuditLog(a.spark, f"{path}.state/audit")
    return log.read(mt.activity(a.table("archive"), "upload", datetime.datetime(2024, 1, 31))).select("tenant_id", "document_id", "type", "meta")


@query("k17_stream_activity", "activity", "SELECT id, tenant_id, type, happened_at FROM activity ORDER BY happened_at DESC, id")
def k17(a: Archive):
    kinds = F.create_map(
        *[F.lit(x) for x in ("view", "search", "signup", "user_added", "error", "processing_failed", "click", "download", "purchase", "upload")]
    )
    feed = _stream(a, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 25).cast("string")).alias("tenant_id"),
        F.try_element_at(kinds, F.col("event_type")).alias("type"),
        F.col("ts").alias("happened_at"),
    )
    path = shared_folder(a.spark, "activity")
    run = stream_activity(feed, path, shared_folder(a.spark, "activity-progress"))
    if not run.awaitTermination(STREAM_SECONDS):
        run.stop()
        raise TimeoutError("the activity stream did not finish")
    return a.spark.read.parquet(path).orderBy(F.desc("happened_at"), F.asc("id"))
