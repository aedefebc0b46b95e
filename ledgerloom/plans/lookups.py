"""Attachments, catalog lookups, duplicates and set operations (C, E, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import joins as jn
from ..sources.archive import Archive
from .registry import query


def _flat(column: str, *parts: str):
    """A list of structs as text, so that engines compare it alike."""
    return F.array_join(
        F.transform(column, lambda e: F.concat_ws(":", *[F.coalesce(e[p].cast("string"), F.lit("-")) for p in parts])), "|"
    )


query(
    "c01_docs_with_tags",
    "archive document_tags tags",
    """SELECT a.id, coalesce(t.tags, '') AS tags FROM archive a LEFT JOIN (
SELECT document_id, string_agg(concat_ws(':', name, tag_id, color), '|' ORDER BY name, tag_id) AS tags
FROM document_tags JOIN tags ON tags.id = tag_id GROUP BY 1) t ON t.document_id = a.id""",
)(
    lambda a: jn.docs_with_tags(a.table("archive").select("id"), a.table("document_tags"), a.table("tags")).select(
        "id", _flat("tags", "name", "id", "color").alias("tags")
    )
)

query(
    "c02_docs_with_correspondent",
    "archive correspondents",
    """SELECT a.id, a.correspondent_id, c.name AS correspondent_name, c.email AS correspondent_email
FROM archive a LEFT JOIN correspondents c ON c.id = a.correspondent_id""",
)(
    lambda a: jn.docs_with_correspondent(
        a.table("archive").select("id", "correspondent_id"), a.table("correspondents")
    )
)

query(
    "c03_docs_with_uploader",
    "archive users",
    """SELECT a.id, coalesce(u.full_name, a.uploaded_by::VARCHAR) AS uploader_name
FROM archive a LEFT JOIN users u ON u.id = a.uploaded_by""",
)(
    lambda a: jn.docs_with_uploader(a.table("archive").select("id", "uploaded_by"), a.table("users")).select(
        "id", "uploader_name"
    )
)

query(
    "c04_docs_with_field_values",
    "archive field_values custom_fields",
    """SELECT a.id, coalesce(t.v, '') AS field_values FROM archive a LEFT JOIN (
SELECT document_id, string_agg(concat_ws(':', position, name, field_type, value), '|' ORDER BY position, name, field_id, value) AS v
FROM field_values JOIN custom_fields f ON f.id = field_id GROUP BY 1) t ON t.document_id = a.id""",
)(
    lambda a: jn.docs_with_field_values(
        a.table("archive").select("id"), a.table("field_values"), a.table("custom_fields")
    ).select("id", _flat("field_values", "position", "name", "field_type", "value").alias("field_values"))
)

_LATEST = """(SELECT * FROM extractions QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1)"""
query(
    "c05_latest_extraction",
    "archive extractions",
    f"""SELECT a.id, e.method AS extraction_method, e.model_name AS vlm_model
FROM archive a LEFT JOIN {_LATEST} e ON e.document_id = a.id""",
)(lambda a: jn.latest_extraction(a.table("archive").select("id"), a.table("extractions")))

query(
    "e01_latest_per_document",
    "extractions",
    f"SELECT document_id, id, method, model_name, confidence, created_at FROM {_LATEST}",
)(
    lambda a: jn.latest_per_document(a.table("extractions")).select(
        "document_id", "id", "method", "model_name", "confidence", "created_at"
    )
)

_NAMED = """named AS (SELECT a.id, min(t.id) AS named_id FROM archive a JOIN document_types t
  ON t.name = a.document_type AND (t.tenant_id IS NULL OR t.tenant_id = a.tenant_id) GROUP BY 1)"""
_INGEST = f""", {_NAMED},
typed AS (SELECT a.*, coalesce(a.document_type_id, n.named_id) AS rid FROM archive a LEFT JOIN named n USING (id))
SELECT d.id, d.rid AS resolved_type_id, coalesce(CASE
  WHEN d.template_id IS NOT NULL THEN CASE WHEN x.id IS NOT NULL THEN x.extraction_method ELSE y.extraction_method END
  WHEN def.id IS NOT NULL THEN def.extraction_method
  WHEN pro.id IS NOT NULL THEN pro.extraction_method ELSE y.extraction_method END, 'cascade') AS strategy
FROM typed d LEFT JOIN templates x ON x.id = d.template_id
LEFT JOIN (SELECT * FROM templates WHERE is_default QUALIFY row_number() OVER (PARTITION BY tenant_id, document_type_id ORDER BY id) = 1) def
  ON def.tenant_id = d.tenant_id AND def.document_type_id = d.rid
LEFT JOIN (SELECT * FROM templates WHERE status = 'promoted' QUALIFY row_number() OVER (PARTITION BY tenant_id, document_type_id ORDER BY id) = 1) pro
  ON pro.tenant_id = d.tenant_id AND pro.document_type_id = d.rid
LEFT JOIN document_types y ON y.id = d.rid"""
query("c06_ingest_strategy", "archive document_types templates", _INGEST)(
    lambda a: jn.ingest_strategy(a.table("archive"), a.table("document_types"), a.table("templates"))
)

_DISPLAY = """SELECT d.id, coalesce(CASE WHEN d.template_id IS NOT NULL THEN x.extraction_method
  WHEN pro.id IS NOT NULL THEN pro.extraction_method ELSE y.extraction_method END, 'cascade') AS strategy
FROM archive d LEFT JOIN templates x ON x.id = d.template_id
LEFT JOIN (SELECT * FROM templates WHERE status = 'promoted' QUALIFY row_number() OVER (PARTITION BY tenant_id, document_type_id ORDER BY id) = 1) pro
  ON pro.tenant_id = d.tenant_id AND pro.document_type_id = d.document_type_id
LEFT JOIN document_types y ON y.id = d.document_type_id AND y.tenant_id = d.tenant_id"""
query("c07_display_strategy", "archive document_types templates", _DISPLAY)(
    lambda a: jn.display_strategy(a.table("archive"), a.table("document_types"), a.table("templates"))
)

query(
    "b19_document_view",
    "archive users extractions document_types templates",
    f""", strat AS ({_DISPLAY})
SELECT a.id, coalesce(nullif(title, ''), original_filename) AS title, coalesce(u.full_name, a.uploaded_by::VARCHAR) AS uploader_name,
  thumbnail_key IS NOT NULL AS has_thumbnail, e.method AS extraction_method, e.model_name AS vlm_model,
  CASE WHEN ocr_used THEN CASE WHEN strategy = 'paddle_qwen' THEN 'paddleocr' ELSE 'rapidocr' END END AS ocr_engine
FROM archive a JOIN strat USING (id) LEFT JOIN users u ON u.id = a.uploaded_by
LEFT JOIN {_LATEST} e ON e.document_id = a.id""",
)(
    lambda a: jn.document_view(
        a.table("archive"),
        a.table("users"),
        a.table("extractions"),
        jn.display_strategy(a.table("archive"), a.table("document_types"), a.table("templates")),
    ).select("id", "title", "uploader_name", "has_thumbnail", "extraction_method", "vlm_model", "ocr_engine")
)


@query(
    "b22_document_by_id",
    "archive document_tags tags correspondents field_values custom_fields",
    """SELECT a.id, a.deleted_at, c.name AS correspondent_name,
  coalesce((SELECT string_agg(concat_ws(':', name, tag_id, color), '|' ORDER BY name, tag_id)
    FROM document_tags JOIN tags ON tags.id = tag_id WHERE document_id = 170), '') AS tags,
  coalesce((SELECT string_agg(concat_ws(':', position, name, value), '|' ORDER BY position, name, field_id, value)
    FROM field_values JOIN custom_fields f ON f.id = field_id WHERE document_id = 170), '') AS field_values
FROM archive a LEFT JOIN correspondents c ON c.id = a.correspondent_id WHERE a.id = 170""",
)
def b22(a: Archive):
    one = flt.document_by_id(a.table("archive"), 170)
    bridge = a.table("document_tags").filter("document_id = 170")
    values = a.table("field_values").filter("document_id = 170")
    out = jn.docs_with_field_values(
        jn.docs_with_tags(jn.docs_with_correspondent(one, a.table("correspondents")), bridge, a.table("tags")),
        values,
        a.table("custom_fields"),
    )
    return out.select(
        "id",
        "deleted_at",
        "correspondent_name",
        _flat("tags", "name", "id", "color").alias("tags"),
        _flat("field_values", "position", "name", "value").alias("field_values"),
    )


query(
    "c08_upload_template_lookup",
    "archive document_types templates",
    """, hinted AS (SELECT *, coalesce(nullif(CASE WHEN id % 3 = 0 THEN '' ELSE document_type END, ''), 'other') AS hint FROM archive),
named AS (SELECT a.id, min(t.id) AS named_id FROM hinted a JOIN document_types t
  ON t.name = a.hint AND (t.tenant_id IS NULL OR t.tenant_id = a.tenant_id) GROUP BY 1)
SELECT h.id, CASE WHEN h.template_id IS NOT NULL THEN coalesce(ty.name, h.hint) ELSE h.hint END AS document_type,
  CASE WHEN h.template_id IS NOT NULL THEN x.document_type_id ELSE n.named_id END AS document_type_id,
  CASE WHEN h.template_id IS NOT NULL THEN h.template_id ELSE def.id END AS template_id
FROM hinted h LEFT JOIN named n USING (id) LEFT JOIN templates x ON x.id = h.template_id
LEFT JOIN document_types ty ON ty.id = x.document_type_id
LEFT JOIN (SELECT * FROM templates WHERE is_default QUALIFY row_number() OVER (PARTITION BY tenant_id, document_type_id ORDER BY id) = 1) def
  ON def.tenant_id = h.tenant_id AND def.document_type_id = n.named_id""",
)(
    lambda a: jn.upload_template_lookup(
        a.table("archive").select(
            "id",
            "tenant_id",
            F.when(F.col("id") % 3 == 0, "").otherwise(F.col("document_type")).alias("type_hint"),
            "template_id",
        ),
        a.table("document_types"),
        a.table("templates"),
    )
)

query(
    "c09_type_config",
    "document_types templates",
    """SELECT y.id AS document_type_id, y.name, CASE WHEN p.id IS NOT NULL THEN p.extraction_method ELSE y.extraction_method END AS extraction_method,
  CASE WHEN p.id IS NOT NULL THEN p.field_mappings ELSE y.json_schema END AS config,
  p.id IS NOT NULL AS is_customized, y.tenant_id IS NULL AS is_system
FROM document_types y LEFT JOIN (SELECT * FROM templates WHERE tenant_id = 't9' AND status = 'promoted'
  QUALIFY row_number() OVER (PARTITION BY document_type_id ORDER BY id) = 1) p ON p.document_type_id = y.id
WHERE y.tenant_id = 't9' OR y.tenant_id IS NULL""",
)(lambda a: jn.type_config(a.table("document_types"), a.table("templates"), "t9"))

query(
    "c10_templates_with_types",
    "document_types templates",
    """SELECT x.id, x.tenant_id, x.name, y.name AS document_type FROM templates x
JOIN document_types y ON y.id = x.document_type_id WHERE x.status = 'promoted'""",
)(lambda a: jn.templates_with_types(a.table("templates"), a.table("document_types")))

query(
    "c11_predefined_fields",
    "archive type_fields custom_fields",
    """, names AS (SELECT DISTINCT tenant_id, document_type FROM archive)
SELECT coalesce(n.tenant_id, l.tenant_id) AS tenant_id, coalesce(n.document_type, l.document_type) AS document_type, coalesce(l.v, '') AS fields
FROM names n FULL JOIN (
SELECT l.tenant_id, document_type, string_agg(concat_ws(':', l.position, f.name, l.id), '|' ORDER BY l.position, f.name, l.id) AS v
FROM type_fields l JOIN custom_fields f ON f.id = l.field_id AND f.tenant_id = l.tenant_id GROUP BY 1, 2) l
ON l.document_type = n.document_type AND l.tenant_id = n.tenant_id""",
)(
    lambda a: jn.predefined_fields(
        a.table("archive").select("tenant_id", "document_type").distinct(),
        a.table("type_fields"),
        a.table("custom_fields"),
    ).select("tenant_id", "document_type", _flat("fields", "position", "field_name", "id").alias("fields"))
)

query(
    "c12_type_counts_with_catalog",
    "archive document_types",
    """SELECT coalesce(y.name, c.document_type) AS name, coalesce(c.n, 0) AS n
FROM (SELECT id, name FROM document_types WHERE tenant_id = 't9' OR tenant_id IS NULL) y FULL JOIN (
SELECT document_type, count(*) AS n FROM archive WHERE tenant_id = 't9' AND deleted_at IS NULL AND extracted_data IS NOT NULL GROUP BY 1) c
ON c.document_type = y.name""",
)(lambda a: jn.type_counts_with_catalog(a.table("archive"), a.table("document_types"), "t9"))


# -- duplicates ----------------------------------------------------------------


def _incoming(a: Archive):
    """Whole text table as a batch of files; its checksums are real hashes."""
    return a.table("texts").select(
        "tenant_id", F.sha2("text", 256).alias("checksum"), "id", F.col("id").alias("idx"), "original_filename"
    )


_FILES = """, files AS (SELECT tenant_id, sha256(text) AS checksum, id, original_filename FROM texts)"""
query(
    "e04_first_in_batch",
    "texts",
    f"""{_FILES} SELECT tenant_id, checksum, id, original_filename FROM files
QUALIFY row_number() OVER (PARTITION BY tenant_id, checksum ORDER BY id) = 1""",
)(lambda a: jn.first_in_batch(_incoming(a)).drop("idx"))

query(
    "c16_ingest_dedup",
    "texts",
    """, files AS (SELECT CASE WHEN id % 3 = 0 THEN 't0' ELSE tenant_id END AS tenant_id, sha256(text) AS checksum, id FROM texts),
known AS (SELECT * FROM files WHERE id IN (SELECT id FROM texts WHERE status = 'completed')),
fresh AS (SELECT * FROM files WHERE id NOT IN (SELECT id FROM known))
SELECT tenant_id, checksum, id FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.tenant_id = f.tenant_id AND k.checksum = f.checksum)
QUALIFY row_number() OVER (PARTITION BY tenant_id, checksum ORDER BY id) = 1""",
)(lambda a: _dedup(a))


def _dedup(a: Archive):
    shared = F.when(F.col("id") % 3 == 0, "t0").otherwise(F.col("tenant_id"))
    files = a.table("texts").select(
        shared.alias("tenant_id"), F.sha2("text", 256).alias("checksum"), "id", F.col("id").alias("idx"), "status"
    )
    existing = files.filter("status = 'completed'")
    batch = files.filter("status <> 'completed'").drop("status")
    return jn.ingest_dedup(batch, existing).drop("idx")


_GROUP = "PARTITION BY tenant_id, vendor, invoice_no ORDER BY uploaded_at, id"
query(
    "c17_duplicate_invoices",
    "archive",
    f"""SELECT id, tenant_id, vendor, invoice_no, duplicate_of FROM (
SELECT *, CASE WHEN row_number() OVER w = 1 THEN nth_value(id, 2) OVER f ELSE first_value(id) OVER f END AS duplicate_of
FROM archive WHERE deleted_at IS NULL AND vendor <> '' AND invoice_no <> ''
WINDOW w AS ({_GROUP}), f AS ({_GROUP} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
WHERE duplicate_of IS NOT NULL""",
)(lambda a: jn.duplicate_invoices(a.table("archive")))

query(
    "e07_duplicate_of_first",
    "archive",
    f"""SELECT tenant_id, vendor, invoice_no, min(id) FILTER (n = 1) AS first_id, min(id) FILTER (n = 2) AS second_id FROM (
SELECT *, row_number() OVER ({_GROUP}) AS n FROM archive
WHERE deleted_at IS NULL AND vendor <> '' AND invoice_no <> '') GROUP BY ALL""",
)(
    lambda a: jn.two_earliest_ids(
        flt.live(a.table("archive")).filter("vendor <> '' AND invoice_no <> ''"), ["tenant_id", "vendor", "invoice_no"]
    )
)

query(
    "e03_disambiguate_filenames",
    "archive",
    """SELECT id, name, CASE WHEN n = 0 THEN name WHEN NOT contains(name, '.') THEN concat(name, ' (', n, ').', name)
  ELSE concat(regexp_extract(name, '^(.*)\\.([^.]*)$', 1), ' (', n, ').', regexp_extract(name, '^(.*)\\.([^.]*)$', 2)) END AS unique_name
FROM (SELECT id, original_filename AS name, row_number() OVER (PARTITION BY original_filename ORDER BY id) - 1 AS n
FROM archive WHERE deleted_at IS NULL)""",
)(lambda a: jn.disambiguate_filenames(flt.live(a.table("archive"))))

_DEFAULT = "row_number() OVER (PARTITION BY tenant_id, document_type_id ORDER BY CASE WHEN is_default THEN 0 ELSE 1 END, created_at, id) = 1"
query(
    "e06_default_template",
    "templates",
    f"SELECT id, tenant_id, document_type_id, {_DEFAULT} AS is_default FROM templates",
)(lambda a: jn.default_templates(a.table("templates")))

query(
    "e06_delete_promotes_default",
    "templates",
    f"SELECT id, tenant_id, document_type_id, {_DEFAULT} AS is_default FROM templates WHERE status <> 'disabled'",
)(lambda a: jn.delete_templates(a.table("templates"), a.table("templates").filter("status = 'disabled'")))

# -- set operations ------------------------------------------------------------

query(
    "g02_observed_minus_catalog",
    "archive document_types",
    """SELECT DISTINCT tenant_id, document_type AS name FROM archive a WHERE NOT EXISTS (
SELECT 1 FROM document_types y WHERE y.name = a.document_type AND (y.tenant_id IS NULL OR y.tenant_id = a.tenant_id))""",
)(lambda a: jn.types_outside_catalog(a.table("archive"), a.table("document_types")))
