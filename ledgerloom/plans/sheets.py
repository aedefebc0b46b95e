"""Typed columns, key aliases, spreadsheets and field discovery (D9, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonvalues as jv
from ..operators import filters as flt
from ..operators import normalize as nz
from ..operators import spreadsheet as sh
from ..sources.archive import Archive
from .registry import query

_ALIAS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in nz.KEY_ALIASES.items())
_WON = f""", alias(raw, canonical) AS (VALUES {_ALIAS_SQL}),
keyed AS (SELECT id, extracted_data, unnest(json_keys(extracted_data)) AS raw FROM archive WHERE extracted_data IS NOT NULL),
won AS (SELECT id, extracted_data, k.raw, coalesce(a.canonical, k.raw) AS canonical FROM keyed k LEFT JOIN alias a ON a.raw = k.raw
  QUALIFY row_number() OVER (PARTITION BY id, coalesce(a.canonical, k.raw) ORDER BY length(k.raw), k.raw) = 1),
val AS (SELECT id, canonical, raw, json_extract(extracted_data, '$."' || raw || '"') AS j FROM won)"""


@query(
    "h05_alias_keys",
    "archive",
    f"""{_WON} SELECT a.id, (SELECT string_agg(canonical || '<' || raw, '|' ORDER BY canonical) FROM val v WHERE v.id = a.id) AS keys,
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'vendor') AS vendor
FROM archive a WHERE a.extracted_data IS NOT NULL""",
)
def h05(a: Archive):
    rows = nz.alias_keys(a.table("archive", heavy=True).filter("extracted_data IS NOT NULL"))
    labels = F.array_sort(F.transform("_won", lambda e: F.concat(e["canonical"], F.lit("<"), e["raw"])))
    return rows.select("id", F.array_join(labels, "|").alias("keys"), jv.text_of(jv.key(F.col("fields"), "vendor")).alias("vendor"))


@query(
    "h06_parse_amount",
    "",
    """SELECT doc_id, try_cast(nullif(regexp_replace(text, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS digits_amount,
  try_cast(regexp_replace('$ ' || n_chars || ',' || doc_id || '.5-', '[^0-9.]', '', 'g') AS DOUBLE) AS amount FROM documents""",
)
def h06(a: Archive):
    label = F.concat(F.lit("$ "), F.col("n_chars"), F.lit(","), F.col("doc_id"), F.lit(".5-"))
    return a.parquet("documents").select(
        "doc_id", nz.parse_amount_text(F.col("text")).alias("digits_amount"), nz.parse_amount_text(label).alias("amount")
    )


@query(
    "h07_coerce_amount",
    "archive",
    """SELECT id, CASE WHEN regexp_full_match(t, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') THEN try_cast(t AS DOUBLE) END AS amount
FROM (SELECT id, trim(replace(CASE id % 5 WHEN 0 THEN ' 1,' || size_bytes || '.5 ' WHEN 1 THEN '-' || size_bytes WHEN 2 THEN '$ ' || size_bytes
WHEN 3 THEN size_bytes || 'd' ELSE '' END, ',', '')) AS t FROM archive)""",
)
def h07(a: Archive):
    size, which = F.col("size_bytes").cast("string"), F.col("id") % 5
    text = (
        F.when(which == 0, F.concat(F.lit(" 1,"), size, F.lit(".5 ")))
        .when(which == 1, F.concat(F.lit("-"), size))
        .when(which == 2, F.concat(F.lit("$ "), size))
        .when(which == 3, F.concat(size, F.lit("d")))
        .otherwise("")
    )
    return a.table("archive", heavy=True).select("id", nz.coerce_amount_text(text).alias("amount"))


_TYPED = """, t AS (SELECT *, extracted_data::JSON AS j FROM archive),
typed AS (SELECT *, CASE WHEN json_type(j, '$.vendor') = 'VARCHAR' THEN nullif(trim(j ->> '$.vendor'), '') END AS v,
  coalesce(nullif(trim(j ->> '$.invoiceNumber'), ''), nullif(trim(j ->> '$.invoice_number'), '')) AS n,
  nullif(trim(j ->> '$.currency'), '') AS c,
  try_cast(replace(CASE WHEN coalesce(j ->> '$.totalAmount', '') NOT IN ('', '0') THEN j ->> '$.totalAmount'
    WHEN coalesce(j ->> '$.total_amount', '') NOT IN ('', '0') THEN j ->> '$.total_amount' ELSE j ->> '$.grand_total' END, ',', '') AS DOUBLE) AS amt FROM t)"""
query(
    "h08_typed_fields",
    "archive",
    f"{_TYPED} SELECT id, v AS vendor, n AS invoice_no, amt AS total_amount, c AS currency FROM typed",
)(lambda a: nz.typed_fields(a.table("archive", heavy=True).select("id", "extracted_data")).select("id", "typed.*"))

query(
    "h09_backfill_typed_columns",
    "archive",
    f"""{_TYPED} SELECT id, CASE WHEN u THEN v ELSE vendor END AS vendor, CASE WHEN u THEN n ELSE invoice_no END AS invoice_no,
  CASE WHEN u THEN CAST(amt AS DECIMAL(12,2)) ELSE total_amount END AS total_amount, CASE WHEN u THEN c ELSE currency END AS currency
FROM (SELECT *, coalesce(v, n, c, amt::VARCHAR) IS NOT NULL AS u FROM typed)""",
)(
    lambda a: nz.backfill_typed_columns(a.table("archive", heavy=True)).select(
        "id", "vendor", "invoice_no", "total_amount", "currency"
    )
)

query("h10_backfill_title", "archive", "SELECT id, coalesce(title, original_filename) AS title FROM archive")(
    lambda a: nz.backfill_title(a.table("archive", heavy=True)).select("id", "title")
)

COLUMNS = ["vendor", "invoiceNumber", "totalAmount", "tax", "po_ref", "status"]
_HEAD = """a.id, original_filename AS filename, document_type AS "documentType", status, strftime(uploaded_at, '%Y-%m-%d') AS "uploadedAt",
  document_date::VARCHAR AS "documentDate",
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'vendor') AS vendor,
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'invoiceNumber') AS "invoiceNumber",
  (SELECT try_cast(regexp_replace(json_extract_string(j, '$'), '[^0-9.]', '', 'g') AS DOUBLE) FROM val v WHERE v.id = a.id AND canonical = 'totalAmount') AS "totalAmount",
  (SELECT try_cast(regexp_replace(json_extract_string(j, '$'), '[^0-9.]', '', 'g') AS DOUBLE) FROM val v WHERE v.id = a.id AND canonical = 'tax') AS tax,
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'po_ref') AS po_ref"""
_SPEC = flt.DocumentFilter(has_data=True)

query(
    "h11_summary_rows",
    "archive",
    f"""{_WON} SELECT {_HEAD},
  coalesce((SELECT CASE WHEN json_type(j) = 'ARRAY' THEN json_array_length(j) END FROM val v WHERE v.id = a.id AND canonical = 'lineItems'),
    CASE WHEN NOT EXISTS (SELECT 1 FROM val v WHERE v.id = a.id AND canonical = 'lineItems') THEN 0 END)::INT AS "itemCount"
FROM archive a WHERE deleted_at IS NULL AND extracted_data IS NOT NULL""",
)(lambda a: sh.summary_rows(flt.apply_filter(a.table("archive", heavy=True), _SPEC), COLUMNS))

_AMT = "try_cast(nullif(regexp_replace({}, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
query(
    "h12_expanded_rows",
    "archive",
    f"""{_WON}, docs AS (SELECT a.id, original_filename AS filename, (SELECT j FROM val v WHERE v.id = a.id AND canonical = 'lineItems') AS li,
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'vendor') AS vendor
  FROM archive a WHERE deleted_at IS NULL AND extracted_data IS NOT NULL),
listed AS (SELECT * FROM docs WHERE json_type(li) = 'ARRAY' AND json_array_length(li) > 0),
it AS (SELECT id, filename, vendor, unnest(range(json_array_length(li)::INT)) AS item_no, json_extract(li, '$[' || item_no || ']') AS e FROM listed),
ob AS (SELECT * FROM it WHERE json_type(e) = 'OBJECT'),
sub AS (SELECT id, filename, vendor, item_no, unnest(range(json_array_length(e, '$.sub_items')::INT)) AS sub_no, json_extract(e, '$.sub_items[' || sub_no || ']') AS s
  FROM ob WHERE json_type(e, '$.sub_items') = 'ARRAY')
SELECT id, filename, vendor, 0 AS item_no, 0 AS depth, -1 AS sub_no, NULL AS "itemDescription", NULL AS "itemQuantity", NULL::DOUBLE AS "itemUnitPrice", NULL::DOUBLE AS "itemAmount"
FROM docs WHERE id NOT IN (SELECT id FROM listed)
UNION ALL SELECT id, filename, vendor, item_no, 0, -1, coalesce(e ->> '$.description', e ->> '$.item_description', e ->> '$.name'),
  coalesce(e ->> '$.quantity', e ->> '$.parent_quantity', e ->> '$.qty'), {_AMT.format("coalesce(e ->> '$.unit_price', e ->> '$.unitPrice')")},
  {_AMT.format("coalesce(e ->> '$.amount', e ->> '$.parent_total_amount')")} FROM ob
UNION ALL SELECT id, filename, vendor, item_no, 1, sub_no, s ->> '$.description', s ->> '$.quantity', {_AMT.format("s ->> '$.unit_price'")}, {_AMT.format("s ->> '$.amount'")} FROM sub""",
)(
    lambda a: sh.expanded_rows(flt.apply_filter(a.table("archive", heavy=True), _SPEC), ["vendor"]).drop(
        "documentType", "status", "uploadedAt", "documentDate"
    )
)

query(
    "a11_spreadsheet_preview",
    "archive",
    f"""{_WON} SELECT a.id, original_filename AS filename,
  (SELECT json_extract_string(j, '$') FROM val v WHERE v.id = a.id AND canonical = 'vendor') AS vendor
FROM archive a WHERE deleted_at IS NULL AND extracted_data IS NOT NULL ORDER BY strftime(uploaded_at, '%Y-%m-%d') DESC, a.id LIMIT 50""",
)(
    lambda a: sh.preview(
        sh.summary_rows(flt.apply_filter(a.table("archive", heavy=True), _SPEC), ["vendor"]), [F.desc("uploadedAt"), F.asc("id")]
    ).select("id", "filename", "vendor")
)

_KEYS = """, alias(raw, canonical) AS (VALUES {alias}),
observed AS (SELECT DISTINCT unnest(json_keys(extracted_data)) AS raw FROM archive WHERE tenant_id = 't9' AND deleted_at IS NULL AND extracted_data IS NOT NULL)"""
_KEYS = _KEYS.format(alias=_ALIAS_SQL)
_FIELDS = """SELECT DISTINCT coalesce(a.canonical, r.raw) AS field FROM ({raws}) r LEFT JOIN alias a ON a.raw = r.raw
WHERE coalesce(a.canonical, r.raw) NOT IN ('lineItems', 'line_items', 'items', 'products')"""


def _tenant_docs(a: Archive):
    return flt.apply_filter(flt.tenant_scope(a.table("archive", heavy=True), "t9"), _SPEC)


query("d09_discover_fields", "archive", f"{_KEYS} {_FIELDS.format(raws='SELECT raw FROM observed')}")(
    lambda a: sh.discover_fields(_tenant_docs(a))
)

query(
    "g01_schema_and_data_keys",
    "archive document_types templates",
    f"""{_KEYS}, promoted AS (SELECT min_by(x.field_mappings, x.id) AS c, count(*) AS n FROM templates x
  WHERE x.tenant_id = 't9' AND x.status = 'promoted' AND x.document_type_id IN (SELECT id FROM document_types WHERE name = 'invoice')),
typed AS (SELECT min_by(json_schema, id) AS c FROM document_types WHERE name = 'invoice' AND (tenant_id = 't9' OR tenant_id IS NULL)),
config AS (SELECT CASE WHEN n > 0 THEN promoted.c ELSE typed.c END AS c FROM promoted, typed),
raws AS (SELECT raw FROM observed UNION SELECT unnest(json_keys(coalesce(c ->> '$._original_schema_str', c))) FROM config)
{_FIELDS.format(raws="SELECT raw FROM raws WHERE raw NOT IN ('_instruction', '_rules', '_original_schema_str', '_hints', '_prompt')")}""",
)(
    lambda a: sh.discover_fields(
        _tenant_docs(a), sh.schema_keys(a.table("templates"), a.table("document_types"), "t9", document_type="invoice")
    )
)

query(
    "g04_list_keys_excluded",
    "archive",
    f"{_KEYS} SELECT raw FROM observed WHERE raw NOT IN ('lineItems', 'line_items', 'items', 'products')",
)(lambda a: sh.observed_keys(_tenant_docs(a)).filter(~F.col("raw").isin(*nz.LIST_KEYS)))

query(
    "g03_sparse_union",
    "archive",
    """SELECT id, vendor, NULL AS currency FROM archive WHERE status = 'failed'
UNION ALL SELECT id, NULL, currency FROM archive WHERE status = 'queued'""",
)(
    lambda a: a.table("archive", heavy=True)
    .filter("status = 'failed'")
    .select("id", "vendor")
    .unionByName(a.table("archive", heavy=True).filter("status = 'queued'").select("id", "currency"), allowMissingColumns=True)
)

query(
    "h13_shallow_merge",
    "archive",
    """SELECT id, list_sort(json_keys(m)).list_aggregate('string_agg', ',') AS keys, m ->> '$.vendor' AS vendor, m ->> '$.reviewed_by' AS reviewed_by
FROM (SELECT id, json_merge_patch(coalesce(extracted_data, '{}')::JSON, ('{"vendor":"Fixed ' || id || '","reviewed_by":"' || uploaded_by || '"}')::JSON) AS m FROM archive)""",
)(lambda a: _merged(a))


def _merged(a: Archive):
    patch = F.concat(
        F.lit('{"vendor":"Fixed '), F.col("id"), F.lit('","reviewed_by":"'), F.col("uploaded_by"), F.lit('"}')
    )
    merged = a.table("archive", heavy=True).select("id", nz.shallow_merge(F.col("extracted_data"), patch).alias("m"))
    return merged.select(
        "id",
        F.array_join(F.array_sort(F.json_object_keys("m")), ",").alias("keys"),
        F.get_json_object("m", "$.vendor").alias("vendor"),
        F.get_json_object("m", "$.reviewed_by").alias("reviewed_by"),
    )


query(
    "h14_split_config",
    "templates",
    """SELECT id, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT unnest(json_keys(coalesce(field_mappings ->> '$._original_schema_str', field_mappings))) AS k)
    WHERE k NOT IN ('_instruction', '_rules', '_hints', '_prompt')) AS keys,
  coalesce(field_mappings ->> '$._instruction', 'default') AS instruction, coalesce(field_mappings ->> '$._rules', 'default') AS rules
FROM templates WHERE field_mappings IS NOT NULL""",
)(
    lambda a: nz.split_config(
        a.table("templates").filter("field_mappings IS NOT NULL"), "field_mappings", "default", "default"
    ).select("id", F.array_join(F.array_sort(F.map_keys("clean_schema")), ",").alias("keys"), "instruction", "rules")
)

query(
    "h22_effective_retention_days",
    "tenants",
    "SELECT tenant_id, coalesce(trash_retention_days, 30) AS retention_days FROM tenants",
)(lambda a: a.table("tenants").select("tenant_id", nz.effective_retention_days().alias("retention_days")))

query(
    "h23_auto_title",
    "archive",
    "SELECT id, CASE WHEN vendor <> '' AND invoice_no <> '' THEN vendor || ' — ' || invoice_no END AS auto_title FROM archive",
)(lambda a: a.table("archive", heavy=True).select("id", nz.auto_title(F.col("vendor"), F.col("invoice_no")).alias("auto_title")))
