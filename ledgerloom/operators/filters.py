"""Row filters, the shared document filter builder, sorting and paging."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 20


# -- tenant access ---------------------------------------------------------


def tenant_scope(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant.  No tenant means no rows, never all rows."""
    if not tenant:
        return df.filter(F.lit(False))
    return df.filter(F.col("tenant_id") == tenant)


def global_or_mine(df: DataFrame, tenant: str) -> DataFrame:
    """System rows (no tenant) and the tenant's own rows."""
    return df.filter((F.col("tenant_id") == tenant) | F.col("tenant_id").isNull())


# -- single predicates -----------------------------------------------------


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def trashed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNotNull())


def by_uploaded_date(df: DataFrame, first=None, last=None) -> DataFrame:
    """Inclusive calendar-day range on the upload time.

    Written as a half-open range on the stored timestamp, so the bounds reach
    the Parquet row-group statistics instead of hiding behind a cast.
    """
    if first is not None:
        df = df.filter(F.col("uploaded_at") >= F.lit(_day(first)).cast("timestamp_ntz"))
    if last is not None:
        end = _day(last) + datetime.timedelta(days=1)
        df = df.filter(F.col("uploaded_at") < F.lit(end).cast("timestamp_ntz"))
    return df


def _day(value) -> datetime.date:
    return datetime.date.fromisoformat(value) if isinstance(value, str) else value


def by_amount(df: DataFrame, low=None, high=None) -> DataFrame:
    if low is not None:
        df = df.filter(F.col("total_amount") >= F.lit(low))
    if high is not None:
        df = df.filter(F.col("total_amount") <= F.lit(high))
    return df


def by_vendor(df: DataFrame, part: str) -> DataFrame:
    """Case-insensitive contains; ``%`` and ``_`` in ``part`` act as wildcards."""
    return df.filter(F.col("vendor").ilike(f"%{part}%"))


def by_tag(df: DataFrame, document_tags: DataFrame, tag_id) -> DataFrame:
    """Documents that carry the tag (the bridge is unique per document and tag)."""
    ids = document_tags.filter(F.col("tag_id") == tag_id).select(F.col("document_id").alias("id"))
    return df.join(ids, "id", "left_semi")


def inbox(df: DataFrame, document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with any inbox tag; the semi join keeps one row per document."""
    inbox_tags = tags.filter("is_inbox_tag").select(F.col("id").alias("tag_id"))
    ids = document_tags.join(inbox_tags, "tag_id", "left_semi").select(F.col("document_id").alias("id"))
    return df.join(ids, "id", "left_semi")


def scalar_text(value: Column) -> Column:
    """Text of a JSON scalar: strings lose their quotes, the rest stays as written."""
    return F.when(value == "null", F.lit(None)).otherwise(
        F.when(value.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)
    )


def custom_field_predicate(
    field_type: str | None, value=None, low=None, high=None, first=None, last=None
) -> Column | None:
    """Predicate over a JSON ``value`` column, or None when nothing was asked for."""
    text = scalar_text(F.col("value"))
    parts: list[Column] = []
    if field_type in ("select", "boolean"):
        if value is not None:
            parts.append(text == value)
    else:
        if value is not None:
            parts.append(text.ilike(f"%{value}%"))
        if field_type == "number":
            number = text.try_cast("decimal(38,10)")
            if low is not None:
                parts.append(number >= F.lit(low))
            if high is not None:
                parts.append(number <= F.lit(high))
        if field_type == "date":
            day = text.try_cast("date")
            if first is not None:
                parts.append(day >= F.lit(_day(first)))
            if last is not None:
                parts.append(day <= F.lit(_day(last)))
    if not parts:
        return None
    result = parts[0]
    for part in parts[1:]:
        result = result & part
    return result


def by_custom_field(
    df: DataFrame, field_values: DataFrame, custom_fields: DataFrame, field_id, **conditions
) -> DataFrame:
    """Documents whose value for one field meets the conditions.

    The field's type comes from the catalog (one row, read while the plan is
    built), never from the caller.  Without a condition nothing is filtered.
    """
    found = resolve_field_type(custom_fields, field_id).first()
    predicate = custom_field_predicate(found["field_type"] if found else None, **conditions)
    if predicate is None:
        return df
    hits = field_values.filter((F.col("field_id") == field_id) & predicate)
    return df.join(hits.select(F.col("document_id").alias("id")), "id", "left_semi")


def resolve_field_type(custom_fields: DataFrame, field_id) -> DataFrame:
    return custom_fields.filter(F.col("id") == field_id).select(F.col("id").alias("field_id"), "field_type")


def relative_date(df: DataFrame, window: str | None, as_of: datetime.datetime) -> DataFrame:
    """Lower bound on the upload time: today, week (7 days) or month (30 days)."""
    starts = {
        "today": as_of.replace(hour=0, minute=0, second=0, microsecond=0),
        "week": as_of - datetime.timedelta(days=7),
        "month": as_of - datetime.timedelta(days=30),
    }
    start = starts.get(window or "any")
    return df if start is None else df.filter(F.col("uploaded_at") >= F.lit(start).cast("timestamp_ntz"))


def missing_extractions(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Finished or reviewed PDFs and images that hold no extracted data, all or the ``limit`` oldest."""
    eligible = F.col("mime_type").isin("application/pdf", "image/png", "image/jpeg", "image/webp", "image/tiff")
    out = df.filter(
        F.col("status").isin("completed", "needs_review") & F.col("extracted_data").isNull() & eligible
    )
    return out if limit is None else out.orderBy("uploaded_at", "id").limit(limit)


def document_by_id(df: DataFrame, doc_id) -> DataFrame:
    """Point lookup that also finds trashed rows."""
    return df.filter(F.col("id") == doc_id)


def active_shares(shares: DataFrame, documents: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Share links that have not expired on documents that are not trashed."""
    days = F.least(F.greatest(F.col("requested_days"), F.lit(1)), F.lit(30))
    expiry = (F.col("created_at") + F.make_dt_interval(days)).alias("expires_at")
    valid = shares.select("*", expiry).filter(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))
    return valid.join(live(documents).select(F.col("id").alias("document_id")), "document_id", "left_semi")


# -- the one filter builder used by list, search and export ------------------


@dataclass(frozen=True)
class DocumentFilter:
    """All document filters; list, search and export share this definition."""

    status: str | None = None
    document_type: str | None = None
    tag_id: int | None = None
    correspondent_id: int | None = None
    date_from: str | None = None
    date_to: str | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    vendor: str | None = None
    inbox: bool = False
    trashed: bool = False
    template_id: int | None = None
    has_data: bool = False
    custom_field_id: int | None = None
    custom_field_value: str | None = None
    custom_field_min: float | None = None
    custom_field_max: float | None = None
    custom_field_date_from: str | None = None
    custom_field_date_to: str | None = None

    @classmethod
    def from_saved_view(cls, state: dict) -> "DocumentFilter":
        """A stored preset; keys the builder does not know are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in state.items() if k in known and v not in (None, "")})


def apply_filter(
    df: DataFrame,
    spec: DocumentFilter,
    document_tags: DataFrame | None = None,
    tags: DataFrame | None = None,
    field_values: DataFrame | None = None,
    custom_fields: DataFrame | None = None,
) -> DataFrame:
    df = trashed(df) if spec.trashed else live(df)
    for column, wanted in (
        ("status", spec.status),
        ("document_type", spec.document_type),
        ("correspondent_id", spec.correspondent_id),
        ("template_id", spec.template_id),
    ):
        if wanted is not None:
            df = df.filter(F.col(column) == wanted)
    if spec.has_data:
        df = df.filter(F.col("extracted_data").isNotNull())
    df = by_uploaded_date(df, spec.date_from, spec.date_to)
    df = by_amount(df, spec.amount_min, spec.amount_max)
    if spec.vendor:
        df = by_vendor(df, spec.vendor)
    if spec.tag_id is not None:
        df = by_tag(df, document_tags, spec.tag_id)
    if spec.inbox:
        df = inbox(df, document_tags, tags)
    if spec.custom_field_id is not None:
        df = by_custom_field(
            df,
            field_values,
            custom_fields,
            spec.custom_field_id,
            value=spec.custom_field_value,
            low=spec.custom_field_min,
            high=spec.custom_field_max,
            first=spec.custom_field_date_from,
            last=spec.custom_field_date_to,
        )
    return df


# -- sorting, paging, top-k --------------------------------------------------

# Sort modes; anything else sorts newest first.
SORT_MODES = {
    "date_desc": ("uploaded_at", True),
    "date_asc": ("uploaded_at", False),
    "name_asc": ("original_filename", False),
    "name_desc": ("original_filename", True),
    "size_asc": ("size_bytes", False),
    "size_desc": ("size_bytes", True),
}


def sort_columns(mode: str | None, ranked: bool = False) -> list[Column]:
    """Order of a listing; relevance applies only to a search in default order."""
    mode = mode if mode in SORT_MODES else "date_desc"
    if ranked and mode == "date_desc":
        return [F.desc("score"), F.desc("uploaded_at"), F.asc("id")]
    column, descending = SORT_MODES[mode]
    return [F.desc(column) if descending else F.asc(column), F.asc("id")]


def sort_documents(df: DataFrame, mode: str | None = None, ranked: bool = False) -> DataFrame:
    return df.orderBy(*sort_columns(mode, ranked))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page; Spark plans order, offset and limit as a bounded top-k."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def recent(df: DataFrame, time_column: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(time_column), F.asc("id")).limit(n)


def limit_with_truncation_flag(df: DataFrame, order: list[Column], limit: int = 5000) -> DataFrame:
    """The first ``limit`` rows, each with a flag telling whether more existed.

    One row more than the limit is taken as a probe, so the source is read once
    and the flag never needs a full count.
    """
    from pyspark.sql import Window

    probe = df.orderBy(*order).limit(limit + 1)
    # The window is over at most limit + 1 rows.
    everything = Window.partitionBy(F.lit(0))
    numbered = probe.withColumn("row_no", F.row_number().over(everything.orderBy(*order)))
    flagged = numbered.withColumn("truncated", F.count(F.lit(1)).over(everything) > limit)
    return flagged.filter(F.col("row_no") <= limit)
