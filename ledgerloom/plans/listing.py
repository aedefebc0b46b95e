"""Filters, listings, dashboards and budgets over the archive (B, D, F)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import filters as flt
from ..sources.archive import Archive
from .registry import query

AS_OF = datetime.datetime(2001, 6, 15, 12, 30)
USAGE_AS_OF = datetime.datetime(2024, 1, 31)

ROW = ("id", "tenant_id", "status", "document_type", "original_filename", "size_bytes")
ROW_SQL = "id, tenant_id, status, document_type, original_filename, size_bytes"


@query(
    "dashboard",
    "archive tenants",
    """
SELECT a.tenant_id, t.name, count(*) AS total_documents,
  count(*) FILTER (a.status = 'completed') AS processed,
  count(*) FILTER (a.status = 'failed') AS failed,
  count(*) FILTER (a.status NOT IN ('completed', 'failed')) AS in_pipeline,
  count(*) FILTER (a.deleted_at IS NULL AND a.mime_type = 'application/pdf') AS pdf_documents,
  sum(CASE WHEN a.deleted_at IS NULL THEN a.size_bytes ELSE 0 END)::BIGINT AS live_bytes
FROM archive a JOIN tenants t USING (tenant_id) GROUP BY ALL""",
)
def dashboard(a: Archive):
    is_live = F.col("deleted_at").isNull()
    stats = agg.dashboard_stats(
        a.table("archive"),
        "tenant_id",
        extra=[
            F.count(F.when(is_live & (agg.mime_family(F.col("mime_type")) == "pdf"), 1)).alias("pdf_documents"),
            F.sum(F.when(is_live, F.col("size_bytes")).otherwise(0)).alias("live_bytes"),
        ],
    )
    return stats.join(a.table("tenants").select("tenant_id", "name"), "tenant_id")


def _filter_query(name: str, condition: str, build, views: str = "archive"):
    query(name, views, f"SELECT {ROW_SQL} FROM archive WHERE {condition}")(lambda a: build(a).select(*ROW))


_filter_query("b01_live", "deleted_at IS NULL", lambda a: flt.live(a.table("archive")))
_filter_query("b01_trashed", "deleted_at IS NOT NULL", lambda a: flt.trashed(a.table("archive")))
_filter_query(
    "b02_by_status",
    "deleted_at IS NULL AND status = 'needs_review'",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(status="needs_review")),
)
_filter_query(
    "b03_by_type",
    "deleted_at IS NULL AND document_type = 'invoice'",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(document_type="invoice")),
)
_filter_query(
    "b04_by_correspondent",
    "deleted_at IS NULL AND correspondent_id = 42",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(correspondent_id=42)),
)
_filter_query(
    "b05_by_uploaded_date",
    "deleted_at IS NULL AND CAST(uploaded_at AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-09-30'",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(date_from="1997-03-01", date_to="1997-09-30")),
)
_filter_query(
    "b06_by_amount",
    "deleted_at IS NULL AND total_amount BETWEEN 1000 AND 90000.5",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(amount_min=1000, amount_max=90000.5)),
)
_filter_query(
    "b07_by_vendor",
    "deleted_at IS NULL AND vendor ILIKE '%DOR _2%'",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(vendor="DOR _2")),
)
_filter_query(
    "b08_by_tag",
    "deleted_at IS NULL AND id IN (SELECT document_id FROM document_tags WHERE tag_id = 7)",
    lambda a: flt.apply_filter(
        a.table("archive"), flt.DocumentFilter(tag_id=7), document_tags=a.table("document_tags")
    ),
    "archive document_tags",
)
_filter_query(
    "b09_inbox",
    "deleted_at IS NULL AND id IN (SELECT document_id FROM document_tags JOIN tags ON tags.id = tag_id WHERE is_inbox_tag)",
    lambda a: flt.apply_filter(
        a.table("archive"), flt.DocumentFilter(inbox=True), a.table("document_tags"), a.table("tags")
    ),
    "archive document_tags tags",
)


def _field_query(name: str, field_id: int, condition: str, **state):
    _filter_query(
        name,
        f"deleted_at IS NULL AND id IN (SELECT document_id FROM field_values WHERE field_id = {field_id} AND {condition})",
        lambda a: flt.apply_filter(
            a.table("archive"),
            flt.DocumentFilter(custom_field_id=field_id, **state),
            field_values=a.table("field_values"),
            custom_fields=a.table("custom_fields"),
        ),
        "archive field_values",
    )


_TEXT = "json_extract_string(value, '$')"
_field_query("b10_custom_field_select", 114, f"{_TEXT} = 'Travel'", custom_field_value="Travel")
_field_query("b10_custom_field_text", 110, f"{_TEXT} ILIKE '%1% TEAM%'", custom_field_value="1% TEAM")
_field_query(
    "b10_custom_field_number",
    111,
    f"CAST({_TEXT} AS DECIMAL(18,4)) BETWEEN 5 AND 30 AND {_TEXT} ILIKE '%1%'",
    custom_field_value="1",
    custom_field_min=5,
    custom_field_max=30,
)
_field_query(
    "b10_custom_field_date",
    112,
    f"CAST({_TEXT} AS DATE) BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    custom_field_date_from="1996-01-01",
    custom_field_date_to="2000-12-31",
)


@query(
    "b11_resolve_field_type",
    "custom_fields field_values",
    """SELECT field_id, field_type, count(*) AS n_values FROM field_values
LEFT JOIN custom_fields ON custom_fields.id = field_id GROUP BY ALL""",
)
def b11(a: Archive):
    catalog = a.table("custom_fields").select(F.col("id").alias("field_id"), "field_type")
    counts = a.table("field_values").groupBy("field_id").agg(F.count("*").alias("n_values"))
    return counts.join(catalog, "field_id", "left")


for _window, _start in (
    ("today", "TIMESTAMP '2001-06-15 00:00:00'"),
    ("week", "TIMESTAMP '2001-06-08 12:30:00'"),
    ("month", "TIMESTAMP '2001-05-16 12:30:00'"),
):
    _filter_query(
        f"b13_relative_date_{_window}",
        f"uploaded_at >= {_start}",
        lambda a, w=_window: flt.relative_date(a.table("archive"), w, AS_OF),
    )

_filter_query(
    "b14_spreadsheet_filter",
    """deleted_at IS NULL AND extracted_data IS NOT NULL AND document_type = 'receipt' AND status = 'completed'
AND CAST(uploaded_at AS DATE) >= DATE '1996-01-01'""",
    lambda a: flt.apply_filter(
        a.table("archive"),
        flt.DocumentFilter(has_data=True, document_type="receipt", status="completed", date_from="1996-01-01"),
    ),
)
_filter_query("b15_tenant_scope", "tenant_id = 't7'", lambda a: flt.tenant_scope(a.table("archive"), "t7"))


@query(
    "b15_tenant_scope_unset",
    "archive",
    "SELECT count(*) AS visible_rows FROM archive WHERE tenant_id = NULL",
)
def b15_unset(a: Archive):
    return flt.tenant_scope(a.table("archive"), None).agg(F.count("*").alias("visible_rows"))


@query(
    "b16_global_or_mine",
    "document_types",
    "SELECT id, tenant_id, name FROM document_types WHERE tenant_id = 't9' OR tenant_id IS NULL",
)
def b16(a: Archive):
    return flt.global_or_mine(a.table("document_types"), "t9").select("id", "tenant_id", "name")


_filter_query(
    "b17_missing_extractions",
    """status IN ('completed', 'needs_review') AND extracted_data IS NULL
AND (mime_type = 'application/pdf' OR mime_type LIKE 'image/%')""",
    lambda a: flt.missing_extractions(a.table("archive"), limit=None),
)
SAVED_VIEW = {"document_type": "contract", "amount_min": 50000, "vendor": "vendor 3", "unknown": 1, "status": ""}
_filter_query(
    "b18_saved_view",
    "deleted_at IS NULL AND document_type = 'contract' AND total_amount >= 50000 AND vendor ILIKE '%vendor 3%'",
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter.from_saved_view(SAVED_VIEW)),
)


@query(
    "b21_active_shares",
    "shares archive",
    """SELECT s.id, s.document_id, s.created_at, s.requested_days,
  s.created_at + INTERVAL '1' DAY * least(greatest(s.requested_days, 1), 30) AS expires_at
FROM shares s WHERE expires_at > TIMESTAMP '2024-01-20 00:00:00'
AND s.document_id IN (SELECT id FROM archive WHERE deleted_at IS NULL)""",
)
def b21(a: Archive):
    active = flt.active_shares(a.table("shares"), a.table("archive"), datetime.datetime(2024, 1, 20))
    return active.select("id", "document_id", "created_at", "requested_days", "expires_at")


# -- sorting, paging, top-k --------------------------------------------------

for _mode, _order in (
    ("date_desc", "uploaded_at DESC"),
    ("date_asc", "uploaded_at"),
    ("name_asc", "original_filename"),
    ("name_desc", "original_filename DESC"),
    ("size_asc", "size_bytes"),
    ("size_desc", "size_bytes DESC"),
):
    query(
        f"f01_sort_{_mode}",
        "archive",
        f"SELECT {ROW_SQL} FROM archive WHERE deleted_at IS NULL ORDER BY {_order}, id",
    )(lambda a, m=_mode: flt.sort_documents(flt.live(a.table("archive")), m).select(*ROW))

query(
    "f03_page",
    "archive",
    f"SELECT {ROW_SQL} FROM archive WHERE deleted_at IS NULL ORDER BY uploaded_at DESC, id LIMIT 20 OFFSET 40",
)(lambda a: flt.page(flt.live(a.table("archive")), flt.sort_columns("date_desc"), 3).select(*ROW))

query(
    "f04_recent_documents",
    "archive",
    f"SELECT {ROW_SQL} FROM archive ORDER BY uploaded_at DESC, id LIMIT 5",
)(lambda a: flt.recent(a.table("archive"), "uploaded_at", 5).select(*ROW))

query(
    "f05_recent_activity",
    "activity",
    "SELECT * FROM activity ORDER BY happened_at DESC, id LIMIT 6",
)(lambda a: flt.recent(a.table("activity"), "happened_at", 6))

query(
    "f05_activity_page",
    "activity",
    "SELECT * FROM activity WHERE document_id = 17 ORDER BY happened_at DESC, id LIMIT 20 OFFSET 20",
)(
    lambda a: flt.page(
        a.table("activity").filter("document_id = 17"), [F.desc("happened_at"), F.asc("id")], 2
    )
)

query(
    "f06_limit_with_truncation_flag",
    "archive",
    """SELECT id, row_number() OVER (ORDER BY uploaded_at DESC, id) AS row_no,
  (SELECT count(*) > 5000 FROM archive WHERE deleted_at IS NULL) AS truncated
FROM archive WHERE deleted_at IS NULL ORDER BY uploaded_at DESC, id LIMIT 5000""",
)(
    lambda a: flt.limit_with_truncation_flag(
        flt.live(a.table("archive")).select("id", "uploaded_at"), flt.sort_columns("date_desc")
    ).select("id", "row_no", "truncated")
)

query(
    "f08_list_by_name",
    "tags",
    "SELECT id, tenant_id, name, color FROM tags ORDER BY name, id",
)(lambda a: a.table("tags").select("id", "tenant_id", "name", "color").orderBy("name", "id"))

query(
    "f08_fields_by_position",
    "custom_fields",
    "SELECT id, position, name FROM custom_fields ORDER BY position, name",
)(lambda a: a.table("custom_fields").select("id", "position", "name").orderBy("position", "name"))

# -- aggregates --------------------------------------------------------------

query(
    "d01_status_counts",
    "archive",
    "SELECT tenant_id, status, count(*) AS n FROM archive GROUP BY ALL",
)(lambda a: agg.status_counts(a.table("archive"), "tenant_id"))

query(
    "d02_dashboard_stats",
    "archive",
    """SELECT count(*) AS total_documents, count(*) FILTER (status = 'completed') AS processed,
count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS in_pipeline FROM archive""",
)(lambda a: agg.dashboard_stats(a.table("archive")))

_FAMILY = """CASE WHEN mime_type = 'application/pdf' THEN 'pdf' WHEN mime_type LIKE 'image/%' THEN 'image'
WHEN mime_type LIKE '%officedocument%' THEN 'office' WHEN mime_type IN ('text/plain', 'text/csv', 'text/markdown') THEN 'text'
WHEN mime_type = 'message/rfc822' THEN 'email' ELSE 'other' END"""
query(
    "d03_mime_family_counts",
    "archive",
    f"SELECT tenant_id, {_FAMILY} AS family, count(*) AS n FROM archive WHERE deleted_at IS NULL GROUP BY ALL",
)(lambda a: agg.mime_family_counts(a.table("archive"), "tenant_id"))

query(
    "d04_type_counts",
    "archive",
    """SELECT tenant_id, document_type, count(*) AS n FROM archive
WHERE deleted_at IS NULL AND extracted_data IS NOT NULL GROUP BY ALL""",
)(lambda a: agg.type_counts(a.table("archive"), "tenant_id"))

_BUDGET = """
SELECT t.tenant_id, coalesce(u.used, 0)::BIGINT AS used, coalesce(t.llm_monthly_token_cap, 2000000)::BIGINT AS cap,
  coalesce(t.llm_monthly_token_cap, 2000000) > 0 AND coalesce(u.used, 0) < coalesce(t.llm_monthly_token_cap, 2000000) AS allowed
FROM tenants t LEFT JOIN (SELECT tenant_id, sum(total_tokens) AS used FROM ai_usage
  WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1) u USING (tenant_id)"""
query("d05_budget_allowed", "tenants ai_usage", _BUDGET)(
    lambda a: agg.budget_allowed(a.table("tenants"), a.table("ai_usage"), USAGE_AS_OF)
)

query(
    "d05_monthly_tokens",
    "ai_usage",
    """SELECT tenant_id, sum(total_tokens)::BIGINT AS used FROM ai_usage
WHERE date_trunc('month', created_at) >= DATE '2024-01-01' GROUP BY 1""",
)(lambda a: agg.monthly_tokens(a.table("ai_usage"), USAGE_AS_OF))

query(
    "d06_quota_check",
    "tenants archive",
    """SELECT tenant_id, storage_used_bytes, storage_limit_bytes, coalesce(b, 0)::BIGINT AS incoming_bytes,
  coalesce(b, 0) <= 0 OR storage_used_bytes + coalesce(b, 0) <= storage_limit_bytes AS accepted
FROM tenants LEFT JOIN (SELECT tenant_id, sum(size_bytes) AS b FROM archive WHERE status = 'queued' GROUP BY 1) USING (tenant_id)""",
)(lambda a: agg.quota_check(a.table("tenants"), a.table("archive").filter("status = 'queued'")))

query(
    "d07_storage_release",
    "tenants archive",
    """SELECT tenant_id, coalesce(b, 0)::BIGINT AS freed_bytes, greatest(storage_used_bytes - coalesce(b, 0), 0)::BIGINT AS storage_used_bytes
FROM tenants LEFT JOIN (SELECT tenant_id, sum(size_bytes) AS b FROM archive WHERE deleted_at IS NOT NULL GROUP BY 1) USING (tenant_id)""",
)(lambda a: agg.storage_release(a.table("tenants"), flt.trashed(a.table("archive"))))

query(
    "d08_page_total",
    "archive",
    "SELECT count(*) AS total FROM archive WHERE deleted_at IS NULL AND status = 'completed'",
)(
    lambda a: flt.apply_filter(a.table("archive"), flt.DocumentFilter(status="completed")).agg(
        F.count("*").alias("total")
    )
)


@query(
    "d10_pages_to_document",
    "",
    """SELECT conv_id AS document_id, count(*) AS page_count,
  trim(string_agg(text, chr(10) || chr(10) ORDER BY turn), E' \\t\\n\\r') AS extracted_text,
  round(avg((50 + length(text) % 50) / 100.0), 9) AS ocr_confidence
FROM conversations WHERE length(text) > 0 OR text = '' GROUP BY 1""",
)
def d10(a: Archive):
    pages = a.parquet("conversations").select(
        F.col("conv_id").alias("document_id"),
        F.col("turn").alias("page_no"),
        "text",
        ((F.length("text") % 50 + 50) / 100.0).alias("confidence"),
    )
    return agg.pages_to_document(pages).withColumn("ocr_confidence", F.round("ocr_confidence", 9))


query(
    "d16_admin_count",
    "users tenants",
    """SELECT tenant_id, count(u.id) AS admins, count(u.id) >= 1 AS has_admin FROM tenants
LEFT JOIN (SELECT id, tenant_id FROM users WHERE role = 'admin') u USING (tenant_id) GROUP BY 1""",
)(lambda a: agg.admin_count(a.table("users"), a.table("tenants")))

query(
    "d17_usage_totals",
    "ai_usage",
    """SELECT document_id, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens,
sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM ai_usage GROUP BY 1""",
)(lambda a: agg.usage_totals(a.table("ai_usage")))

query(
    "e05_running_budget",
    "ai_usage tenants",
    """SELECT id, u.tenant_id, coalesce(sum(total_tokens) OVER w, 0)::BIGINT AS used_before,
  coalesce(llm_monthly_token_cap, 2000000) > 0 AND coalesce(sum(total_tokens) OVER w, 0) < coalesce(llm_monthly_token_cap, 2000000) AS admitted
FROM ai_usage u LEFT JOIN tenants t ON t.tenant_id = u.tenant_id
WINDOW w AS (PARTITION BY u.tenant_id, date_trunc('month', created_at) ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)(
    lambda a: agg.running_budget(a.table("ai_usage"), a.table("tenants")).select(
        "id", "tenant_id", "used_before", "admitted"
    )
)
