"""Lookups that attach related rows to documents, and strategy resolution.

No join carries a broadcast hint: Spark broadcasts a side only when its measured
size is under the session threshold and shuffles (with skew splitting) beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import global_or_mine, live
from .ordered import earlier_total

DEFAULT_STRATEGY = "cascade"


def docs_with_tags(df: DataFrame, document_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Attach the list of (name, id, color); documents without tags get an empty list."""
    entry = F.struct("name", F.col("tag_id").alias("id"), "color")
    named = document_tags.join(tags.select(F.col("id").alias("tag_id"), "name", "color"), "tag_id")
    lists = named.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(entry)).alias("tags"))
    joined = df.join(lists, "id", "left")
    return joined.withColumn("tags", F.coalesce("tags", F.array().cast(lists.schema["tags"].dataType)))


def docs_with_correspondent(df: DataFrame, correspondents: DataFrame) -> DataFrame:
    side = correspondents.select(
        F.col("id").alias("correspondent_id"),
        F.col("name").alias("correspondent_name"),
        F.col("email").alias("correspondent_email"),
    )
    return df.join(side, "correspondent_id", "left")


def docs_with_uploader(df: DataFrame, users: DataFrame) -> DataFrame:
    """Uploader's name; an unknown uploader shows as the id."""
    side = users.select(F.col("id").alias("uploaded_by"), "full_name")
    name = F.coalesce("full_name", F.col("uploaded_by").cast("string"))
    return df.join(side, "uploaded_by", "left").withColumn("uploader_name", name).drop("full_name")


def docs_with_field_values(df: DataFrame, field_values: DataFrame, custom_fields: DataFrame) -> DataFrame:
    """Attach field values, ordered by the catalog's position and name."""
    catalog = custom_fields.select(F.col("id").alias("field_id"), "name", "field_type", "position")
    entry = F.struct("position", "name", "field_id", "field_type", "value")
    lists = (
        field_values.select("document_id", "field_id", "value")
        .join(catalog, "field_id")
        .groupBy(F.col("document_id").alias("id"))
        .agg(F.array_sort(F.collect_list(entry)).alias("field_values"))
    )
    joined = df.join(lists, "id", "left")
    return joined.withColumn(
        "field_values", F.coalesce("field_values", F.array().cast(lists.schema["field_values"].dataType))
    )


def latest_per_document(attempts: DataFrame) -> DataFrame:
    """Newest attempt per document, by time and then id.

    ``max_by`` is a partial aggregate: every task keeps one row per document, so
    a document with very many attempts never gathers in one place.
    """
    others = [c for c in attempts.columns if c != "document_id"]
    newest = F.max_by(F.struct(*others), F.struct("created_at", "id")).alias("row")
    return attempts.groupBy("document_id").agg(newest).select("document_id", "row.*")


def latest_extraction(df: DataFrame, extractions: DataFrame) -> DataFrame:
    newest = latest_per_document(extractions).select(
        F.col("document_id").alias("id"),
        F.col("method").alias("extraction_method"),
        F.col("model_name").alias("vlm_model"),
    )
    return df.join(newest, "id", "left")


def document_view(
    df: DataFrame, users: DataFrame, extractions: DataFrame, strategies: DataFrame
) -> DataFrame:
    """Output projection of a document page.

    ``strategies`` maps id to strategy (see ``display_strategy``).
    """
    full = latest_extraction(docs_with_uploader(df, users), extractions).join(strategies, "id", "left")
    engine = F.when(
        F.col("ocr_used"), F.when(F.col("strategy") == "paddle_qwen", "paddleocr").otherwise("rapidocr")
    )
    return full.withColumns(
        {
            "title": F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("original_filename")),
            "has_thumbnail": F.col("thumbnail_key").isNotNull(),
            "ocr_engine": engine,
        }
    )


# -- catalog lookups ---------------------------------------------------------


def _first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key; the row filter is pushed below the shuffle by Spark."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_n = 1").drop("_n")


def type_by_name(documents: DataFrame, types: DataFrame) -> DataFrame:
    """(tenant_id, document_type) -> type id: system rows and the tenant's own.

    Several rows may share a name; the lowest id wins.  Only the distinct pairs
    are looked up, not every document, and a name that many tenants own meets
    each tenant's own row only.
    """
    pairs = documents.select("tenant_id", "document_type").distinct()
    catalog = types.select("id", "tenant_id", F.col("name").alias("document_type"))
    system = catalog.filter("tenant_id IS NULL").groupBy("document_type").agg(F.min("id").alias("system_id"))
    own = catalog.filter("tenant_id IS NOT NULL").groupBy("tenant_id", "document_type").agg(F.min("id").alias("own_id"))
    hit = pairs.join(system, "document_type", "left").join(own, ["tenant_id", "document_type"], "left")
    found = hit.select("tenant_id", "document_type", F.least("system_id", "own_id").alias("named_type_id"))
    return found.filter("named_type_id IS NOT NULL")


def ranked_template(templates: DataFrame, condition: Column, prefix: str) -> DataFrame:
    """One template per tenant and type among those meeting ``condition``."""
    chosen = F.min_by(F.struct("id", "extraction_method"), "id").alias("t")
    picked = templates.filter(condition).groupBy("tenant_id", "document_type_id").agg(chosen)
    return picked.select(
        "tenant_id",
        F.col("document_type_id").alias("resolved_type_id"),
        F.col("t.id").alias(f"{prefix}_id"),
        F.col("t.extraction_method").alias(f"{prefix}_method"),
        F.lit(True).alias(f"{prefix}_found"),
    )


def ingest_strategy(df: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """Strategy used when a document is processed.

    Explicit template, else the type's default template, else a promoted one,
    else the type's own method, else the fixed default.  A document without a
    type id first resolves it by name.
    """
    names = type_by_name(df, types)
    with_type = df.join(names, ["tenant_id", "document_type"], "left").withColumn(
        "resolved_type_id", F.coalesce("document_type_id", "named_type_id")
    )
    explicit = templates.select(
        F.col("id").alias("template_id"),
        F.col("extraction_method").alias("explicit_method"),
        F.lit(True).alias("explicit_found"),
    )
    default = ranked_template(templates, F.col("is_default"), "default")
    promoted = ranked_template(templates, F.col("status") == "promoted", "promoted")
    type_methods = types.select(F.col("id").alias("resolved_type_id"), F.col("extraction_method").alias("type_method"))
    joined = (
        with_type.join(explicit, "template_id", "left")
        .join(default, ["tenant_id", "resolved_type_id"], "left")
        .join(promoted, ["tenant_id", "resolved_type_id"], "left")
        .join(type_methods, "resolved_type_id", "left")
    )
    # A named template switches the type lookup off even when it is unknown.
    no_explicit = F.col("template_id").isNull()
    method = (
        F.when(F.col("explicit_found"), F.col("explicit_method"))
        .when(no_explicit & F.col("default_found"), F.col("default_method"))
        .when(no_explicit & F.col("promoted_found"), F.col("promoted_method"))
        .otherwise(F.col("type_method"))
    )
    return joined.select(df["id"], F.coalesce(method, F.lit(DEFAULT_STRATEGY)).alias("strategy"), "resolved_type_id")


def display_strategy(df: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """Strategy shown for a document: no default-template step and no name lookup."""
    explicit = templates.select(F.col("id").alias("template_id"), F.col("extraction_method").alias("explicit_method"))
    promoted = ranked_template(templates, F.col("status") == "promoted", "promoted").withColumnRenamed(
        "resolved_type_id", "document_type_id"
    )
    # Only the tenant's own types carry a method here; system rows do not.
    type_methods = types.filter(F.col("tenant_id").isNotNull()).select(
        "tenant_id", F.col("id").alias("document_type_id"), F.col("extraction_method").alias("type_method")
    )
    joined = (
        df.select("id", "tenant_id", "template_id", "document_type_id")
        .join(explicit, "template_id", "left")
        .join(promoted, ["tenant_id", "document_type_id"], "left")
        .join(type_methods, ["tenant_id", "document_type_id"], "left")
    )
    method = F.when(F.col("template_id").isNotNull(), F.col("explicit_method")).otherwise(
        F.when(F.col("promoted_found"), F.col("promoted_method")).otherwise(F.col("type_method"))
    )
    return joined.select("id", F.coalesce(F.when(method != "", method), F.lit(DEFAULT_STRATEGY)).alias("strategy"))


def upload_template_lookup(uploads: DataFrame, types: DataFrame, templates: DataFrame) -> DataFrame:
    """Type id, type name and template for uploads with a hint or a template.

    Input: id, tenant_id, type_hint, template_id.  An explicit template decides
    the type; otherwise the hinted name (``other`` when blank) and its default
    template do.
    """
    hinted = uploads.withColumn(
        "document_type", F.coalesce(F.when(F.col("type_hint") != "", F.col("type_hint")), F.lit("other"))
    )
    named = type_by_name(hinted, types)
    explicit = templates.select(
        F.col("id").alias("template_id"), F.col("document_type_id").alias("template_type_id")
    ).join(
        types.select(F.col("id").alias("template_type_id"), F.col("name").alias("template_type")),
        "template_type_id",
        "left",
    )
    default = ranked_template(templates, F.col("is_default"), "default").select(
        "tenant_id", F.col("resolved_type_id").alias("named_type_id"), "default_id"
    )
    joined = (
        hinted.join(named, ["tenant_id", "document_type"], "left")
        .join(explicit, "template_id", "left")
        .join(default, ["tenant_id", "named_type_id"], "left")
    )
    by_template = F.col("template_id").isNotNull()
    return joined.select(
        uploads["id"],
        F.when(by_template, F.coalesce("template_type", "document_type")).otherwise(F.col("document_type")).alias("document_type"),
        F.when(by_template, F.col("template_type_id")).otherwise(F.col("named_type_id")).alias("document_type_id"),
        F.when(by_template, F.col("template_id")).otherwise(F.col("default_id")).alias("template_id"),
    )


def type_config(types: DataFrame, templates: DataFrame, tenant: str) -> DataFrame:
    """Active configuration per type for one tenant: promoted template, else the type."""
    mine = templates.filter((F.col("tenant_id") == tenant) & (F.col("status") == "promoted"))
    best = mine.groupBy("document_type_id").agg(
        F.min_by(F.struct("id", "extraction_method", "field_mappings"), "id").alias("t")
    )
    visible = global_or_mine(types, tenant).select(
        F.col("id").alias("document_type_id"), "name", "tenant_id", "extraction_method", "json_schema"
    )
    customized = F.col("t").isNotNull()
    return visible.join(best, "document_type_id", "left").select(
        "document_type_id",
        "name",
        F.when(customized, F.col("t.extraction_method")).otherwise(F.col("extraction_method")).alias("extraction_method"),
        F.when(customized, F.col("t.field_mappings")).otherwise(F.col("json_schema")).alias("config"),
        customized.alias("is_customized"),
        F.col("tenant_id").isNull().alias("is_system"),
    )


def templates_with_types(templates: DataFrame, types: DataFrame) -> DataFrame:
    side = types.select(F.col("id").alias("document_type_id"), F.col("name").alias("document_type"))
    promoted = templates.filter("status = 'promoted'").select("id", "tenant_id", "name", "document_type_id")
    return promoted.join(side, "document_type_id").select("id", "tenant_id", "name", "document_type")


def predefined_fields(all_types: DataFrame, type_fields: DataFrame, custom_fields: DataFrame) -> DataFrame:
    """Attached fields per tenant and type, ordered by position and name; empty list when none.

    all_types: tenant_id, document_type.  A field counts only for the tenant that owns it.
    """
    catalog = custom_fields.select("tenant_id", F.col("id").alias("field_id"), F.col("name").alias("field_name"), "field_type")
    entry = F.struct("position", "field_name", F.col("id"), "field_id", "field_type", "required")
    lists = (
        type_fields.join(catalog, ["tenant_id", "field_id"])
        .groupBy("tenant_id", "document_type")
        .agg(F.array_sort(F.collect_list(entry)).alias("fields"))
    )
    joined = all_types.join(lists, ["tenant_id", "document_type"], "full_outer")
    return joined.withColumn("fields", F.coalesce("fields", F.array().cast(lists.schema["fields"].dataType)))


def type_counts_with_catalog(df: DataFrame, types: DataFrame, tenant: str) -> DataFrame:
    """Catalog types with counts (0 if none) plus observed types missing there."""
    held = live(df).filter((F.col("tenant_id") == tenant) & F.col("extracted_data").isNotNull())
    counts = held.groupBy(F.col("document_type").alias("name")).agg(F.count("*").alias("observed"))
    catalog = global_or_mine(types, tenant).select("id", "name")
    return catalog.join(counts, "name", "full_outer").select("name", F.coalesce("observed", F.lit(0)).alias("n"))


def types_outside_catalog(df: DataFrame, types: DataFrame) -> DataFrame:
    """(tenant_id, name) of document types in use that neither the system nor the tenant has in its catalog."""
    used = df.select("tenant_id", F.col("document_type").alias("name")).distinct()
    system = types.filter("tenant_id IS NULL").select("name")
    own = types.filter("tenant_id IS NOT NULL").select("tenant_id", "name")
    return used.join(system, "name", "left_anti").join(own, ["tenant_id", "name"], "left_anti")


# -- self joins and deduplication ----------------------------------------------


def first_in_batch(files: DataFrame, order: str = "idx") -> DataFrame:
    """First file per tenant and checksum in upload order (``order`` differs from file to file).

    Only keys and places are aggregated and shuffled; the files' other columns stay where they are until
    the winners are known.
    """
    return _at_places(files, _first_places(files, order), order)


def _first_places(files: DataFrame, order: str) -> DataFrame:
    return files.groupBy("tenant_id", "checksum").agg(F.min(order).alias(order))


def _at_places(files: DataFrame, places: DataFrame, order: str) -> DataFrame:
    wanted = places.select(*[F.col(c).alias(f"_{c}") for c in ("tenant_id", "checksum", order)])
    same = F.col(order) == F.col(f"_{order}")
    for key in ("tenant_id", "checksum"):
        same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return files.join(wanted, same, "left_semi")


def fresh_places(files: DataFrame, existing: DataFrame, order: str = "idx") -> DataFrame:
    """(tenant_id, checksum, place) of the first file of each checksum that is unknown to the tenant's archive."""
    known = existing.select("tenant_id", "checksum").distinct()
    return _first_places(files, order).join(known, ["tenant_id", "checksum"], "left_anti")


def ingest_dedup(files: DataFrame, existing: DataFrame, order: str = "idx") -> DataFrame:
    """New files: first of their checksum and unknown to the tenant's archive.

    Trashed documents still count as existing.  Which files stay is decided on keys and places alone.
    """
    return _at_places(files, fresh_places(files, existing, order), order)


def two_earliest_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """The two earliest documents per key.

    The rank filter is applied per task before the shuffle (Spark's window group
    limit), so at most two rows per key and task move.
    """
    w = Window.partitionBy(*keys).orderBy("uploaded_at", "id")
    ranked = df.select(*keys, "id", "uploaded_at", F.row_number().over(w).alias("n")).filter("n <= 2")
    return ranked.groupBy(*keys).agg(
        F.min(F.when(F.col("n") == 1, F.col("id"))).alias("first_id"),
        F.min(F.when(F.col("n") == 2, F.col("id"))).alias("second_id"),
    )


def duplicate_invoices(df: DataFrame) -> DataFrame:
    """Live documents that share tenant, vendor and invoice number with another one.

    ``duplicate_of`` is the earliest other document of the group.
    """
    keys = ["tenant_id", "vendor", "invoice_no"]
    keyed = live(df).filter(
        (F.length("vendor") > 0) & (F.length("invoice_no") > 0)
    ).select("id", "uploaded_at", *keys)
    pairs = two_earliest_ids(keyed, keys).filter(F.col("second_id").isNotNull())
    other = F.when(F.col("id") == F.col("first_id"), F.col("second_id")).otherwise(F.col("first_id"))
    return keyed.join(pairs, keys).select("id", *keys, other.alias("duplicate_of"))


def disambiguate_filenames(df: DataFrame) -> DataFrame:
    """Second and later equal names become ``stem (n).ext``.

    Numbers follow id order, and a very common name is not ordered in one task (see ``ordered``).
    """
    name = F.coalesce(F.when(F.col("original_filename") != "", F.col("original_filename")), F.col("id").cast("string"))
    base = df.select("id", name.alias("name"))
    n = F.col("n")
    stem = F.regexp_extract("name", r"(?s)^(.*)\.([^.]*)$", 1)
    ext = F.regexp_extract("name", r"(?s)^(.*)\.([^.]*)$", 2)
    has_ext = F.col("name").contains(".")
    suffix = F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))
    renamed = (
        # a trailing dot leaves no extension: the number follows the whole name
        F.when(has_ext & (ext == ""), F.concat("name", suffix))
        .when(has_ext, F.concat(F.when(stem == "", F.col("name")).otherwise(stem), suffix, F.lit("."), ext))
        # without a dot the whole name is taken as the extension and repeated
        .otherwise(F.concat("name", suffix, F.lit("."), "name"))
    )
    numbered = earlier_total(base, ["name"], ["id"], F.lit(1), "n")
    return numbered.select("id", "name", F.when(n == 0, F.col("name")).otherwise(renamed).alias("unique_name"))


def default_templates(templates: DataFrame) -> DataFrame:
    """Exactly one default per tenant and type: a flagged one, else the first made."""
    order = F.struct(F.when(F.col("is_default"), 0).otherwise(1).alias("o"), "created_at", "id")
    chosen = templates.groupBy("tenant_id", "document_type_id").agg(F.min_by("id", order).alias("default_id"))
    return templates.join(chosen, ["tenant_id", "document_type_id"]).select(
        "id", "tenant_id", "document_type_id", (F.col("id") == F.col("default_id")).alias("is_default")
    )


def delete_templates(templates: DataFrame, removed: DataFrame) -> DataFrame:
    """Templates left after a delete, with another default where the default went."""
    left_over = templates.join(removed.select("id"), "id", "left_anti")
    return default_templates(left_over)
