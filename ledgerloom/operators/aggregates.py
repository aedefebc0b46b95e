"""Dashboards, budgets, storage and page merges.

All of these are partial (map-side) aggregates, so a hot tenant or status is
reduced before the shuffle.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import live
from .ordered import earlier_total

DEFAULT_MONTHLY_TOKENS = 2_000_000

OFFICE_PREFIX = "application/vnd.openxmlformats-officedocument."


def status_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Documents per status, trashed ones included."""
    return df.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def dashboard_stats(df: DataFrame, *keys: str, extra: list[Column] = ()) -> DataFrame:
    """Totals; everything not completed or failed counts as in the pipeline."""
    done = F.count(F.when(F.col("status") == "completed", 1))
    failed = F.count(F.when(F.col("status") == "failed", 1))
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_documents"),
        done.alias("processed"),
        failed.alias("failed"),
        (F.count("*") - done - failed).alias("in_pipeline"),
        *extra,
    )


def mime_family(mime: Column) -> Column:
    return (
        F.when(mime == "application/pdf", "pdf")
        .when(mime.isin("image/png", "image/jpeg", "image/webp", "image/tiff"), "image")
        .when(
            mime.isin(
                OFFICE_PREFIX + "wordprocessingml.document",
                OFFICE_PREFIX + "spreadsheetml.sheet",
                OFFICE_PREFIX + "presentationml.presentation",
            ),
            "office",
        )
        .when(mime.isin("text/plain", "text/csv", "text/markdown"), "text")
        .when(mime == "message/rfc822", "email")
        .otherwise("other")
    )


def mime_family_counts(df: DataFrame, *keys: str) -> DataFrame:
    return live(df).groupBy(*keys, mime_family(F.col("mime_type")).alias("family")).agg(F.count("*").alias("n"))


def type_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Live documents that hold extracted data, per type."""
    held = live(df).filter(F.col("extracted_data").isNotNull())
    return held.groupBy(*keys, "document_type").agg(F.count("*").alias("n"))


def monthly_tokens(usage: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Tokens spent per tenant since the start of the month of ``as_of``."""
    start = as_of.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    spent = usage.filter(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    return spent.groupBy("tenant_id").agg(F.sum("total_tokens").alias("used"))


def token_cap(column: str = "llm_monthly_token_cap") -> Column:
    return F.coalesce(F.col(column), F.lit(DEFAULT_MONTHLY_TOKENS).cast("bigint"))


def budget_allowed(tenants: DataFrame, usage: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Per tenant: tokens used this month, the cap, and whether calls are allowed."""
    joined = tenants.join(monthly_tokens(usage, as_of), "tenant_id", "left")
    used, cap = F.coalesce("used", F.lit(0)), token_cap()
    return joined.select("tenant_id", used.alias("used"), cap.alias("cap"), ((cap > 0) & (used < cap)).alias("allowed"))


def quota_check(tenants: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accept or reject a whole batch per tenant; an empty batch always passes."""
    size = incoming.groupBy("tenant_id").agg(F.sum("size_bytes").alias("incoming_bytes"))
    need = F.coalesce("incoming_bytes", F.lit(0))
    fits = (need <= 0) | (F.col("storage_used_bytes") + need <= F.col("storage_limit_bytes"))
    return tenants.join(size, "tenant_id", "left").select(
        "tenant_id", "storage_used_bytes", "storage_limit_bytes", need.alias("incoming_bytes"), fits.alias("accepted")
    )


def storage_release(tenants: DataFrame, removed: DataFrame) -> DataFrame:
    """Tenant storage after removing documents, never below zero."""
    freed = removed.groupBy("tenant_id").agg(F.sum("size_bytes").alias("freed_bytes"))
    left_over = F.col("storage_used_bytes") - F.coalesce("freed_bytes", F.lit(0))
    return tenants.select("tenant_id", "storage_used_bytes").join(freed, "tenant_id", "left").select(
        "tenant_id",
        F.coalesce("freed_bytes", F.lit(0)).alias("freed_bytes"),
        F.greatest(left_over, F.lit(0)).alias("storage_used_bytes"),
    )


def purge_summary(purged: DataFrame, retention: DataFrame) -> DataFrame:
    """One audit row per tenant that lost documents; ``retention`` has the days."""
    counts = purged.groupBy("tenant_id").agg(F.count("*").alias("purged"))
    note = F.format_string(
        "Auto-purged %d document(s) past the %d-day retention period", F.col("purged"), F.col("retention_days")
    )
    return counts.join(retention, "tenant_id").select(
        "tenant_id", F.lit("permanent_delete").alias("type"), F.lit("system").alias("user_name"), "purged", note.alias("meta")
    )


def admin_count(users: DataFrame, tenants: DataFrame) -> DataFrame:
    """Admins per tenant and whether at least one is left."""
    admins = users.filter(F.col("role") == "admin").groupBy("tenant_id").agg(F.count("*").alias("admins"))
    n = F.coalesce("admins", F.lit(0))
    return tenants.join(admins, "tenant_id", "left").select("tenant_id", n.alias("admins"), (n >= 1).alias("has_admin"))


def usage_totals(usage: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens over all calls of a document."""
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return usage.groupBy("document_id").agg(F.count("*").alias("calls"), *sums)


def pages_to_document(pages: DataFrame) -> DataFrame:
    """Join page texts by a blank line in page order, skipping empty pages.

    Input: document_id, page_no, text, confidence.  Mean confidence covers every
    page and is 0.0 when there is none.
    """
    kept = F.when(F.length("text") > 0, F.struct("page_no", "text"))
    grouped = pages.groupBy("document_id").agg(
        F.count("*").alias("page_count"),
        F.array_sort(F.collect_list(kept)).alias("kept"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("ocr_confidence"),
    )
    text = F.array_join(F.transform("kept", lambda p: p["text"]), "\n\n")
    return grouped.select(
        "document_id", "page_count", F.btrim(text, F.lit(" \t\n\r\f\u000b")).alias("extracted_text"), "ocr_confidence"
    )


def evaluation_rates(results: DataFrame) -> DataFrame:
    """Pass rate over candidates and share of documents left for the model.

    Input: one row per document with is_candidate and gate_passed.
    """
    candidates = F.count(F.when(F.col("is_candidate"), 1))
    passed = F.count(F.when(F.col("is_candidate") & F.col("gate_passed"), 1))
    total = F.count("*")
    return results.agg(
        total.alias("total"),
        candidates.alias("candidates"),
        passed.alias("passed"),
        F.coalesce(F.try_divide(passed * 100.0, candidates), F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.try_divide((candidates - passed) * 100.0, total), F.lit(0.0)).alias("model_share"),
    )


# -- ordered budgets ---------------------------------------------------------


def running_budget(calls: DataFrame, tenants: DataFrame, month: Column | None = None) -> DataFrame:
    """Admit calls in time order while the month's earlier tokens are below the cap.

    Because tokens are never negative, a refused call cannot be followed by an admitted one, so summing all
    earlier calls equals summing the admitted ones.  Calls of one moment count in id order.
    """
    if month is None:
        month = F.date_trunc("month", "created_at")
    timed = calls.withColumn("month", month)
    summed = earlier_total(timed, ["tenant_id", "month"], ["created_at", "id"], F.coalesce("total_tokens", F.lit(0)), "used_before")
    caps = tenants.select("tenant_id", token_cap().alias("cap"))
    return (
        summed.join(caps, "tenant_id", "left")
        .withColumn("cap", F.coalesce("cap", F.lit(DEFAULT_MONTHLY_TOKENS).cast("bigint")))
        .withColumn("admitted", (F.col("cap") > 0) & (F.col("used_before") < F.col("cap")))
    )
