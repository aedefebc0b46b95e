"""Routing of processed documents and golden evaluation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import monthly_tokens, running_budget
from .extract import candidate_json
from .normalize import auto_title, typed_fields

ACCEPT_CONFIDENCE = 0.7
XML = "application/xml"
# Media types with page images for the model.
PAGE_IMAGE_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/webp", "image/tiff")


def model_queue(scored: DataFrame) -> Column:
    """Candidates that failed the gate and have page images."""
    return (
        F.col("document_type").isNotNull()
        & ~F.coalesce("gate_passed", F.lit(False))
        & F.col("mime_type").isin(*PAGE_IMAGE_TYPES)
    )


def admit_model_calls(
    queued: DataFrame, results: DataFrame, tenants: DataFrame, usage: DataFrame, as_of: datetime.datetime
) -> DataFrame:
    """Which queued documents may call the model, in upload order.

    A call is admitted while the tenant's tokens of the month (earlier usage plus
    the admitted calls before it) are below its cap.
    """
    calls = queued.join(results.select("id", "total_tokens"), "id", "left").select(
        "id",
        "tenant_id",
        F.col("uploaded_at").alias("created_at"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
    )
    spent = monthly_tokens(usage, as_of)
    caps = tenants.join(spent, "tenant_id", "left").select("tenant_id", "llm_monthly_token_cap", F.coalesce("used", F.lit(0)).alias("used"))
    running = running_budget(calls, caps, month=F.lit(as_of.strftime("%Y-%m")))
    with_used = running.join(caps.select("tenant_id", "used"), "tenant_id", "left")
    total = F.col("used_before") + F.coalesce("used", F.lit(0))
    return with_used.select("id", ((F.col("cap") > 0) & (total < F.col("cap"))).alias("admitted"))


def route(scored: DataFrame, results: DataFrame, admitted: DataFrame) -> DataFrame:
    """Final status and typed columns of processed documents.

    ``scored`` are gate-scored candidates (non-candidates included) with id,
    tenant_id, mime_type and title; ``results`` are model answers (id, model_type,
    model_confidence, model_fields as JSON); ``admitted`` comes from
    ``admit_model_calls``.
    """
    decided = decide(scored.join(results, "id", "left").join(admitted, "id", "left"))
    typed = typed_fields(decided)
    named = auto_title(F.col("typed.vendor"), F.col("typed.invoice_no"))
    return typed.select(
        "id",
        "tenant_id",
        "status",
        "extraction_status",
        "extraction_method",
        F.col("final_type").alias("document_type"),
        "extracted_data",
        F.col("typed.vendor").alias("vendor"),
        F.col("typed.invoice_no").alias("invoice_no"),
        F.col("typed.total_amount").try_cast("decimal(12,2)").alias("total_amount"),
        F.col("typed.currency").alias("currency"),
        F.when(F.col("accepted"), F.coalesce(named, F.col("title"))).otherwise(F.col("title")).alias("title"),
    )


def decide(joined: DataFrame) -> DataFrame:
    """Add status, extraction status and method, data and type to scored documents.

    ``joined`` also has model_type, model_confidence, model_fields and admitted.
    """
    structured = F.col("mime_type").isin(*PAGE_IMAGE_TYPES, XML)
    attempted = structured & F.col("document_type").isNotNull()
    by_rules = attempted & F.coalesce("gate_passed", F.lit(False))
    queued = attempted & ~by_rules & (F.col("mime_type") != XML)
    called = queued & F.coalesce("admitted", F.lit(False))
    answered = called & F.col("model_fields").isNotNull()
    by_model = answered & (F.col("model_confidence") >= ACCEPT_CONFIDENCE)
    extraction = (
        F.when(~attempted, "none")
        .when(by_rules | by_model, "accepted")
        .when(queued & ~called, "skipped_budget")
        .otherwise("low_confidence")
    )
    return joined.withColumns(
        {
            "extraction_status": extraction,
            "extraction_method": F.when(by_rules | (attempted & ~queued), "deterministic").when(queued, "vlm"),
            "status": F.when(attempted & ~by_rules & ~by_model, "needs_review").otherwise("completed"),
            "extracted_data": F.when(by_rules, candidate_json()).when(answered, F.col("model_fields")),
            "final_type": F.when(by_rules, F.col("document_type")).when(answered, F.col("model_type")),
            "accepted": by_rules | by_model,
            "queued": queued,
        }
    )


def reextract_route(docs: DataFrame, results: DataFrame, admitted: DataFrame) -> DataFrame:
    """Apply re-run model results: data is overwritten, an accepted result clears review."""
    joined = docs.join(results, "id", "left").join(admitted, "id", "left")
    has_text = F.length(F.coalesce("extracted_text", F.lit(""))) > 0
    tried = (
        (has_text | (F.col("status") == "completed"))
        & F.col("mime_type").isin(*PAGE_IMAGE_TYPES)
        & F.coalesce("admitted", F.lit(False))
    )
    answered = tried & F.col("model_fields").isNotNull()
    accepted = answered & (F.col("model_confidence") >= ACCEPT_CONFIDENCE)
    # NULL-safe: a row without an answer is unchanged.
    changed = F.coalesce(answered, F.lit(False))
    updated = joined.withColumns(
        {
            "status": F.when(accepted & (F.col("status") == "needs_review"), "completed").otherwise(F.col("status")),
            "extracted_data": F.when(changed, F.col("model_fields")).otherwise(F.col("extracted_data")),
            "document_type": F.when(changed, F.col("model_type")).otherwise(F.col("document_type")),
            "_changed": changed,
        }
    )
    typed = typed_fields(updated)
    names = ("vendor", "invoice_no", "currency")
    out = {n: F.when(F.col("_changed"), F.col(f"typed.{n}")).otherwise(F.col(n)) for n in names}
    amount = F.col("typed.total_amount").try_cast("decimal(12,2)")
    out["total_amount"] = F.when(F.col("_changed"), amount).otherwise(F.col("total_amount"))
    return typed.withColumns(out).select(*docs.columns)


def evaluate_against_golden(results: DataFrame, golden: DataFrame) -> DataFrame:
    """Per document and field: OK or DIFF.

    Both inputs are long tables (document, field, value); a field missing on one
    side counts as NULL there.
    """
    joined = results.withColumnRenamed("value", "actual").join(
        golden.withColumnRenamed("value", "expected"), ["document", "field"], "full_outer"
    )
    return joined.withColumn("verdict", F.when(F.col("actual").eqNullSafe(F.col("expected")), "OK").otherwise("DIFF"))


def gate_mismatches(scored: DataFrame, golden: DataFrame) -> DataFrame:
    """Documents whose candidate or pass decision differs from the expectation.

    Input: scored(id, is_candidate, gate_passed), golden(id, is_candidate,
    expected_gate_pass); an unset expectation is not checked.
    """
    want = golden.select("id", F.col("is_candidate").alias("want_candidate"), "expected_gate_pass")
    joined = scored.join(want, "id")
    wrong_type = F.col("is_candidate") != F.coalesce("want_candidate", F.lit(False))
    wrong_gate = F.col("is_candidate") & F.col("expected_gate_pass").isNotNull() & (
        F.col("gate_passed") != F.col("expected_gate_pass")
    )
    return joined.filter(wrong_type | wrong_gate).select(
        "id", wrong_type.alias("candidate_mismatch"), F.coalesce(wrong_gate, F.lit(False)).alias("gate_mismatch")
    )
