"""State-table maintenance: each operator returns the new table and its events.

Id sets and patches join the table on the document id, which is unique, so no
join key here can be hot.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonvalues as jv
from .aggregates import purge_summary, storage_release
from .audit import AuditLog
from .normalize import effective_retention_days, shallow_merge

# Kinds of audit events.
ACTIVITY_TYPES = (
    "upload", "processing_complete", "processing_failed", "search", "download", "user_added", "edit",
    "trash", "restore", "permanent_delete", "duplicate_detected", "user_removed", "role_changed",
)


def _at(moment: datetime.datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def activity(
    changed: DataFrame, kind: str, at: datetime.datetime, user_id=None, user_name: str = "system", meta: Column | None = None
) -> DataFrame:
    """One audit row per changed document."""
    if kind not in ACTIVITY_TYPES:
        raise ValueError(f"unknown activity type: {kind}")
    return changed.select(
        "tenant_id",
        F.lit(kind).alias("type"),
        F.col("id").alias("document_id"),
        F.col("original_filename").alias("document_name"),
        F.lit(user_id).cast("bigint").alias("user_id"),
        F.lit(user_name).alias("user_name"),
        _at(at).alias("happened_at"),
        (F.lit(None).cast("string") if meta is None else meta).alias("meta"),
    )


def append_activity(events: DataFrame, path: str, batch: str) -> None:
    """Append audit rows to the log; a batch that is written again replaces itself (see ``audit``)."""
    AuditLog(events.sparkSession, path).append(events, batch)


def _mark(docs: DataFrame, ids: DataFrame, eligible: Column) -> DataFrame:
    """Add ``_hit`` for rows in the id set that may change."""
    wanted = ids.select("id").distinct().withColumn("_in", F.lit(True))
    return docs.join(wanted, "id", "left").withColumn("_hit", F.coalesce(F.col("_in"), F.lit(False)) & eligible).drop("_in")


def _apply(docs: DataFrame, marked: DataFrame, changes: dict[str, Column]) -> DataFrame:
    updates = {name: F.when(F.col("_hit"), value).otherwise(F.col(name)) for name, value in changes.items()}
    return marked.withColumns(updates).select(*docs.columns, "_hit")


def split_changed(result: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(whole table, changed rows) of a maintenance result."""
    return result.drop("_hit"), result.filter("_hit").drop("_hit")


def bulk_trash(docs: DataFrame, ids: DataFrame, at: datetime.datetime) -> DataFrame:
    return _apply(docs, _mark(docs, ids, F.col("deleted_at").isNull()), {"deleted_at": _at(at)})


def bulk_restore(docs: DataFrame, ids: DataFrame) -> DataFrame:
    marked = _mark(docs, ids, F.col("deleted_at").isNotNull())
    return _apply(docs, marked, {"deleted_at": F.lit(None).cast("timestamp_ntz")})


def bulk_set_type(docs: DataFrame, ids: DataFrame, document_type: str) -> DataFrame:
    return _apply(docs, _mark(docs, ids, F.lit(True)), {"document_type": F.lit(document_type)})


def bulk_tag_assign(document_tags: DataFrame, ids: DataFrame, tag_id) -> DataFrame:
    """Bridge with the tag on all given documents, each pair once."""
    added = ids.select(F.col("id").alias("document_id"), F.lit(tag_id).cast("bigint").alias("tag_id"))
    return document_tags.select("document_id", "tag_id").unionByName(added).dropDuplicates(["document_id", "tag_id"])


def bulk_tag_remove(document_tags: DataFrame, ids: DataFrame, tag_id) -> DataFrame:
    gone = ids.select(F.col("id").alias("document_id"), F.lit(tag_id).cast("bigint").alias("tag_id"))
    return document_tags.join(gone, ["document_id", "tag_id"], "left_anti")


# -- trash -----------------------------------------------------------------------


def expired_trash(docs: DataFrame, tenants: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Trashed rows older than the tenant's retention, for tenants due for a check.

    A tenant checked within the last 24 hours is skipped; the cutoff is strict.
    """
    last = F.col("trash_last_purged_at")
    due = tenants.filter(last.isNull() | (last <= F.lit(as_of - datetime.timedelta(hours=24)).cast("timestamp_ntz")))
    cutoffs = due.select(
        "tenant_id", (_at(as_of) - F.make_dt_interval(effective_retention_days())).alias("cutoff")
    )
    trash = docs.filter(F.col("deleted_at").isNotNull())
    return trash.join(cutoffs, "tenant_id").filter(F.col("deleted_at") < F.col("cutoff")).drop("cutoff")


def purge_expired(docs: DataFrame, tenants: DataFrame, as_of: datetime.datetime) -> dict[str, DataFrame]:
    """Kept documents, purged documents, tenants after the purge and audit rows."""
    purged = expired_trash(docs, tenants, as_of)
    last = F.col("trash_last_purged_at")
    due = last.isNull() | (last <= F.lit(as_of - datetime.timedelta(hours=24)).cast("timestamp_ntz"))
    freed = storage_release(tenants, purged)
    after = (
        tenants.drop("storage_used_bytes", "freed_bytes")
        .join(freed, "tenant_id")
        .withColumn("trash_last_purged_at", F.when(due, _at(as_of)).otherwise(last))
    )
    days = tenants.select("tenant_id", effective_retention_days().alias("retention_days"))
    return {
        "kept": docs.join(purged.select("id"), "id", "left_anti"),
        "purged": purged,
        "tenants": after,
        "events": purge_summary(purged, days),
    }


def empty_trash(docs: DataFrame, tenants: DataFrame) -> dict[str, DataFrame]:
    trash = docs.filter(F.col("deleted_at").isNotNull())
    return {
        "kept": docs.filter(F.col("deleted_at").isNull()),
        "purged": trash,
        "tenants": storage_release(tenants, trash),
    }


def permanent_delete(docs: DataFrame, ids: DataFrame, tenants: DataFrame) -> dict[str, DataFrame]:
    """Delete the given documents, but only those already in the trash."""
    gone = docs.filter(F.col("deleted_at").isNotNull()).join(ids.select("id"), "id", "left_semi")
    return {
        "kept": docs.join(gone.select("id"), "id", "left_anti"),
        "purged": gone,
        "tenants": storage_release(tenants, gone),
    }


def orphaned_keys(purged: DataFrame) -> DataFrame:
    """Storage keys to delete after a purge."""
    keys = F.explode(F.array("storage_key", "thumbnail_key")).alias("storage_key")
    return purged.select("id", keys).filter(F.col("storage_key").isNotNull())


# -- edits -----------------------------------------------------------------------


def patch_documents(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply edits; only keys named in ``keys`` are touched.

    Patches: id, keys (array of field names), title, document_type, document_date,
    correspondent_id, data_patch.  NULL clears the date and the correspondent but
    leaves title and type alone; ``data_patch`` is merged into the extracted data.
    """
    p = patches.select("id", *[F.col(c).alias(f"p_{c}") for c in patches.columns if c != "id"])
    joined = docs.join(p, "id", "left")

    def given(name: str) -> Column:
        return F.coalesce(F.array_contains("p_keys", name), F.lit(False))

    def keep_if_null(name: str) -> Column:
        return F.when(given(name) & F.col(f"p_{name}").isNotNull(), F.col(f"p_{name}")).otherwise(F.col(name))

    def clear_if_null(name: str) -> Column:
        return F.when(given(name), F.col(f"p_{name}")).otherwise(F.col(name))

    merged = shallow_merge(F.col("extracted_data"), F.col("p_data_patch"))
    has_patch = given("data_patch") & F.col("p_data_patch").isNotNull()
    return joined.withColumns(
        {
            "title": keep_if_null("title"),
            "document_type": keep_if_null("document_type"),
            "document_date": clear_if_null("document_date"),
            "correspondent_id": clear_if_null("correspondent_id"),
            "extracted_data": F.when(has_patch, merged).otherwise(F.col("extracted_data")),
            # The search text follows a changed title.
            "reindex": given("title") & F.col("p_title").isNotNull(),
        }
    ).select(*docs.columns, "reindex")


def upsert_field_values(existing: DataFrame, updates: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """Last write per document and field wins; deletes clear the value.

    existing(document_id, field_id, value), updates(… , seq); ``seq`` is anything
    that orders the writes of a field (a number, a time or a struct).
    """
    kind = updates.schema["seq"].dataType
    none = F.lit(None).cast(kind)
    both = existing.select("document_id", "field_id", "value", F.struct(F.lit(0).alias("new"), none.alias("seq")).alias("at")).unionByName(
        updates.select("document_id", "field_id", "value", F.struct(F.lit(1).alias("new"), F.col("seq")).alias("at"))
    )
    # A partial aggregate: a field written very often shrinks in each task.
    latest = both.groupBy("document_id", "field_id").agg(F.max_by("value", "at").alias("value"))
    return latest if deletes is None else latest.join(deletes, ["document_id", "field_id"], "left_anti")


def _spec_list(column: Column) -> Column:
    return F.from_json(column, "array<variant>")


def upload_time_fields(
    docs: DataFrame, custom_fields: DataFrame, type_fields: DataFrame
) -> dict[str, DataFrame]:
    """Field values, attachments and new fields sent along with an upload.

    docs: id, tenant_id, document_type, and the JSON texts ``field_values``
    (object of field id -> value), ``attach_fields`` (list of fieldId, value) and
    ``new_fields`` (list of name, fieldType, value).  Unparseable texts and bad
    entries are skipped, and so are fields of other tenants; they never fail the document.
    """
    get = lambda v, k, t: F.try_variant_get(v, f"$.{k}", t)
    has = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    catalog = custom_fields.select("tenant_id", F.col("id").alias("field_id"))
    own = ["tenant_id", "field_id"]

    attach = docs.select("id", "tenant_id", "document_type", F.posexplode(_spec_list(F.col("attach_fields"))).alias("pos", "s"))
    attach = attach.select(
        "id", "tenant_id", "document_type", "pos", get(F.col("s"), "fieldId", "bigint").alias("field_id"),
        F.when(has(F.col("s"), "value"), F.to_json(get(F.col("s"), "value", "variant"))).alias("value"),
    ).join(catalog, own, "left_semi")

    fresh = docs.select("id", "tenant_id", "document_type", F.posexplode(_spec_list(F.col("new_fields"))).alias("pos", "s"))
    fresh = fresh.select(
        "id", "tenant_id", "document_type", "pos", get(F.col("s"), "name", "string").alias("name"),
        get(F.col("s"), "fieldType", "string").alias("field_type"),
        F.when(has(F.col("s"), "value"), F.to_json(get(F.col("s"), "value", "variant"))).alias("value"),
    )
    valid = F.col("field_type").isin("text", "number", "date", "boolean", "select") & (F.btrim("name") != "")
    # An existing or earlier name of the tenant makes the entry a duplicate.
    taken = custom_fields.select("tenant_id", "name")
    created = (
        fresh.filter(valid)
        .join(taken, ["tenant_id", "name"], "left_anti")
        .groupBy("tenant_id", "name")
        .agg(F.min_by(F.struct("id", "document_type", "field_type", "value"), F.struct("id", "pos")).alias("r"))
        .select("tenant_id", "name", "r.*")
        .withColumn("field_id", F.xxhash64("tenant_id", "name"))
    )

    values = docs.select("id", "tenant_id", F.explode(jv.as_object(F.col("field_values"))).alias("key", "v")).select(
        "id", "tenant_id", F.col("key").try_cast("bigint").alias("field_id"), F.to_json("v").alias("value")
    ).join(catalog, own, "left_semi")

    # Later kinds overwrite earlier ones: attached, then new, then plain values.
    writes = (
        attach.filter(F.col("value").isNotNull()).select("id", "field_id", "value", F.col("pos").cast("bigint").alias("seq"))
        .unionByName(created.filter(F.col("value").isNotNull()).select("id", "field_id", "value", F.lit(1 << 40).alias("seq")))
        .unionByName(values.select("id", "field_id", "value", F.lit(1 << 41).alias("seq")))
    )
    key = ["tenant_id", "document_type", "field_id"]
    links = attach.select(*key).unionByName(created.select(*key)).distinct()
    return {
        "new_fields": created.select("field_id", "tenant_id", "name", "field_type"),
        "new_type_fields": links.join(type_fields.select(*key), key, "left_anti"),
        "values": writes.groupBy(F.col("id").alias("document_id"), "field_id").agg(F.max_by("value", "seq").alias("value")),
    }


def retry_failed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Failed documents of the id set go back to the queue."""
    return _apply(docs, _mark(docs, ids, F.col("status") == "failed"), {"status": F.lit("queued")})


def reprocess(docs: DataFrame, requests: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """Queue documents again and clear their text, data and page count.

    requests: id, new_type_id, new_template_id; a template also sets its type.
    """
    names = types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    tpl = templates.select(F.col("id").alias("new_template_id"), F.col("document_type_id").alias("template_type_id"))
    wanted = (
        requests.join(tpl, "new_template_id", "left")
        .withColumn("type_id", F.coalesce("template_type_id", "new_type_id"))
        .join(names, "type_id", "left")
        .select("id", "new_template_id", "type_id", "type_name", F.lit(True).alias("_hit"))
    )
    marked = docs.join(wanted, "id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    known = F.col("type_name").isNotNull()
    changes = {
        "status": F.lit("queued"),
        "extracted_data": F.lit(None).cast("string"),
        "page_count": F.lit(None).cast("int"),
        "document_type": F.coalesce("type_name", "document_type"),
        "document_type_id": F.when(known, F.col("type_id")).otherwise(F.col("document_type_id")),
        "template_id": F.coalesce("new_template_id", "template_id"),
    }
    if "extracted_text" in docs.columns:
        changes["extracted_text"] = F.lit(None).cast("string")
    return _apply(docs, marked, changes)


# -- integrity -------------------------------------------------------------------


def cascade_delete(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Child rows whose parent stays."""
    return children.join(removed.select(F.col("id").alias(key)), key, "left_anti")


def cascade_null(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Children keep their row but lose the reference to a removed parent."""
    gone = removed.select(F.col("id").alias(key), F.lit(True).alias("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(key))
    return children.join(gone, key, "left").withColumn(key, kept).select(*children.columns)


@dataclass(frozen=True)
class Dependency:
    """Rows of ``child`` that point to ``parent`` by ``key`` go with it, or lose the reference."""

    parent: str
    child: str
    key: str
    action: str  # delete or null


# What depends on what.
DEPENDENCIES = (
    Dependency("documents", "document_tags", "document_id", "delete"),
    Dependency("documents", "field_values", "document_id", "delete"),
    Dependency("documents", "extractions", "document_id", "delete"),
    Dependency("documents", "shares", "document_id", "delete"),
    Dependency("documents", "jobs", "document_id", "delete"),
    Dependency("documents", "activity", "document_id", "null"),
    Dependency("documents", "ai_usage", "document_id", "null"),
    Dependency("documents", "documents", "duplicate_of", "null"),
    Dependency("documents", "templates", "sample_document_id", "null"),
    Dependency("tags", "document_tags", "tag_id", "delete"),
    Dependency("custom_fields", "field_values", "field_id", "delete"),
    Dependency("custom_fields", "type_fields", "field_id", "delete"),
    Dependency("correspondents", "documents", "correspondent_id", "null"),
    Dependency("document_types", "templates", "document_type_id", "delete"),
    Dependency("document_types", "documents", "document_type_id", "null"),
    Dependency("templates", "documents", "template_id", "null"),
    Dependency("templates", "extractions", "template_id", "null"),
    Dependency("users", "activity", "user_id", "null"),
    Dependency("users", "shares", "created_by", "null"),
)


def cascade(
    tables: dict[str, DataFrame], parent: str, removed: DataFrame, dependencies: tuple[Dependency, ...] = DEPENDENCIES
) -> dict[str, DataFrame]:
    """The given tables after rows of ``parent`` (``removed``: id) went, with all that depends on them.

    Deletions are followed from table to table, so what depends on a deleted dependent goes or loses its
    reference too.  Tables that nothing touches come back as they are; a reference column that a table does not
    have is skipped.
    """
    known = [d for d in dependencies if d.child in tables and d.key in tables[d.child].columns]
    gone = {parent: removed.select("id").distinct()}
    pending, done = [parent], dict(tables)
    if parent in done:
        done[parent] = done[parent].join(gone[parent], "id", "left_anti")
    while pending:
        current = pending.pop(0)
        for d in known:
            if d.parent != current or d.action != "delete":
                continue
            lost = gone[current].select(F.col("id").alias(d.key))
            if any(other.parent == d.child for other in known):
                ids = tables[d.child].join(lost, d.key, "left_semi").select("id")
                gone[d.child] = ids.unionByName(gone[d.child]).distinct() if d.child in gone else ids.distinct()
                pending.append(d.child)
            done[d.child] = done[d.child].join(lost, d.key, "left_anti")
    for d in known:
        if d.action == "null" and d.parent in gone:
            done[d.child] = cascade_null(done[d.child], gone[d.parent], d.key)
    return done


def purge_dependents(tables: dict[str, DataFrame], purged: DataFrame) -> dict[str, DataFrame]:
    """All tables after a purge (``purge_expired``, ``empty_trash`` or ``permanent_delete``)."""
    return cascade(tables, "documents", purged)


def unique_key_check(df: DataFrame, *keys: str, fold: bool = False) -> DataFrame:
    """Key values that occur more than once; NULL keys never collide."""
    columns = [F.lower(k).alias(k) if fold and k != "tenant_id" else F.col(k) for k in keys]
    counted = df.dropna(subset=list(keys)).groupBy(*columns).agg(F.count("*").alias("n"))
    return counted.filter("n > 1")
