"""Model answers, merges, validation and page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pyjson import order_keys_by_schema
from ..operators import model_output as mo
from ..sources.archive import Archive
from .registry import query

# Answers as a model writes them: plain, fenced, in prose, flat, cut off, hopeless.
_RAW = """, raw AS (SELECT event_id, event_id // 7 AS document_id,
  (event_id + event_id // 7) % 7 AS form, CASE event_type WHEN 'view' THEN 'invoice' WHEN 'click' THEN 'Receipt' WHEN 'error' THEN 'fax' ELSE 'other' END AS ty,
  CAST(CAST(json_extract_string(props, '$.k') AS INT) AS DOUBLE) / 50 AS conf, event_id AS e FROM events)"""


def _answers(a: Archive):
    """One answer per event; seven in a row are the chunks of a document."""
    k = F.get_json_object("props", "$.k").cast("int")
    form = (F.col("event_id") + F.floor(F.col("event_id") / 7)) % 7
    kind = (
        F.when(F.col("event_type") == "view", "invoice")
        .when(F.col("event_type") == "click", "Receipt")
        .when(F.col("event_type") == "error", "fax")
        .otherwise("other")
    )
    number = F.col("event_id").cast("string")
    confidence = (k.cast("double") / 50).cast("string")
    head = F.concat(F.lit('{"documentType":"'), kind, F.lit('","confidence":'), confidence)
    whole = F.concat(
        head, F.lit(',"fields":{"vendor":"V'), number, F.lit('","total":'), number, F.lit(',"note":"","line_items":[{"d":"'), number, F.lit('"}]}}')
    )
    raw = (
        F.when(form == 0, whole)
        .when(form == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Result: "), whole, F.lit(" (end)")))
        .when(form == 3, F.concat(head.substr(F.lit(1), F.length(head)), F.lit(',"buyer":"B'), number, F.lit('","line_items":[]}')))
        .when(form == 4, F.concat(head, F.lit(',"fields":{"vendor":"V'), number, F.lit('","line_items":[{"d":"'), number, F.lit('"},{"d":"cut')))
        .when(form == 5, F.concat(head, F.lit(',"fields":{"grand_total":'), number, F.lit(',"due')))
        .otherwise("No field could be read.")
    )
    return a.wide("events").select(
        "event_id",
        F.floor(F.col("event_id") / 7).cast("bigint").alias("document_id"),
        (F.col("event_id") % 7).alias("chunk_no"),
        raw.alias("raw"),
    )


_PARSED = f"""{_RAW}, parsed AS (SELECT event_id, document_id, event_id % 7 AS chunk_no, form,
  CASE lower(ty) WHEN 'invoice' THEN 'invoice' WHEN 'receipt' THEN 'receipt' ELSE 'other' END AS model_type, greatest(0.0::DOUBLE, least(1.0::DOUBLE, conf)) AS confidence,
  CASE WHEN form IN (0, 1, 2, 4) THEN 'V' || e END AS vendor, CASE WHEN form = 3 THEN 'B' || e END AS buyer,
  CASE WHEN form IN (0, 1, 2) THEN e END AS total, CASE WHEN form = 5 THEN e END AS grand_total,
  CASE WHEN form IN (0, 1, 2) THEN [e::VARCHAR] WHEN form = 4 THEN [e::VARCHAR, 'cut'] WHEN form = 3 THEN [] END AS items FROM raw WHERE form <> 6)"""


def _parts(a: Archive):
    return mo.parse_model_output(_answers(a)).filter("parsed IS NOT NULL")


query(
    "h17_parse_model_output",
    "",
    f"""WITH {_PARSED.lstrip(', ')} SELECT event_id, model_type, round(confidence, 6) AS confidence, vendor, buyer, total::VARCHAR AS total, grand_total::VARCHAR AS grand_total,
  array_to_string(items, ',') AS items FROM parsed UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM raw WHERE form = 6""",
)(lambda a: _shown(a))


def _shown(a: Archive):
    value = lambda k: F.try_variant_get(F.try_element_at("fields", F.lit(k)), "$", "string").alias(k)
    items = F.try_variant_get(F.try_element_at("fields", F.lit("line_items")), "$", "array<variant>")
    names = F.array_join(F.transform(items, lambda i: F.try_variant_get(i, "$.d", "string")), ",")
    return mo.parse_model_output(_answers(a)).select(
        "event_id", "model_type", F.round("confidence", 6).alias("confidence"), value("vendor"), value("buyer"), value("total"), value("grand_total"), names.alias("items")
    )


_MERGED = f"""WITH {_PARSED.lstrip(', ')}
SELECT document_id, 'vendor' AS key, '"' || min_by(vendor, chunk_no) || '"' AS value FROM parsed WHERE vendor IS NOT NULL GROUP BY 1
UNION ALL SELECT document_id, 'buyer', '"' || min_by(buyer, chunk_no) || '"' FROM parsed WHERE buyer IS NOT NULL GROUP BY 1
UNION ALL SELECT document_id, 'total', max_by(total, chunk_no)::VARCHAR FROM parsed WHERE total IS NOT NULL GROUP BY 1
UNION ALL SELECT document_id, 'grand_total', max_by(grand_total, chunk_no)::VARCHAR FROM parsed WHERE grand_total IS NOT NULL GROUP BY 1
UNION ALL SELECT document_id, 'line_items', '[' || string_agg(list_aggregate(list_transform(items, lambda d: '{{"d":"' || d || '"}}'), 'string_agg', ','), ',' ORDER BY chunk_no) || ']'
  FROM parsed WHERE items IS NOT NULL GROUP BY 1"""

query("d11_merge_chunks", "", _MERGED)(
    # "note" is always empty and merges to nothing.
    lambda a: mo.merge_chunk_fields(_parts(a).select("document_id", "chunk_no", "fields"))
)


def _two_phases(a: Archive):
    """The first answer of a document is the header call's, and every answer is an item call's."""
    parts = _parts(a).select("document_id", "chunk_no", "fields", "model_type", "confidence")
    calls = F.when(F.col("chunk_no") == 0, F.array(F.lit("header"), F.lit("items"))).otherwise(F.array(F.lit("items")))
    return mo.two_phase_parts(parts.withColumn("call", F.explode(calls)))


# The header's line items are not merged a second time.
query("j16_two_phase_fields", "", _MERGED)(lambda a: mo.merge_chunk_fields(_two_phases(a).select("document_id", "chunk_no", "fields")))

query(
    "j16_two_phase_header",
    "",
    f"""WITH {_PARSED.lstrip(', ')}, calls AS (SELECT document_id, chunk_no, model_type, confidence FROM parsed UNION ALL SELECT document_id, -1, model_type, confidence FROM parsed WHERE chunk_no = 0),
c AS (SELECT document_id, model_type, count(*) AS n, min(chunk_no) AS f FROM calls WHERE model_type <> 'other' GROUP BY 1, 2),
w AS (SELECT document_id, model_type FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1)
SELECT document_id, round(avg(confidence::DECIMAL(18,9)), 6) AS confidence, coalesce(any_value(w.model_type), 'other') AS model_type FROM calls LEFT JOIN w USING (document_id) GROUP BY 1""",
)(lambda a: mo.merge_chunk_header(_two_phases(a)).withColumn("confidence", F.round("confidence", 6)))

query(
    "d11_merge_chunk_header",
    "",
    f"""WITH {_PARSED.lstrip(', ')}, c AS (SELECT document_id, model_type, count(*) AS n, min(chunk_no) AS f FROM parsed WHERE model_type <> 'other' GROUP BY 1, 2),
w AS (SELECT document_id, model_type FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1)
SELECT document_id, round(avg(confidence::DECIMAL(18,9)), 6) AS confidence, coalesce(any_value(w.model_type), 'other') AS model_type FROM parsed LEFT JOIN w USING (document_id) GROUP BY 1""",
)(lambda a: mo.merge_chunk_header(_parts(a)).withColumn("confidence", F.round("confidence", 6)))


def _pages(a: Archive):
    n = F.length("text").cast("string")
    data = F.concat(
        F.lit('{"vendor_details":{"company_name":"'), F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("C"), n)),
        F.lit('"},"financials":{"total_amount":'), n, F.lit('},"line_items":['), F.col("turn").cast("string"),
        F.lit('],"page":'), n, F.lit(',"validation_errors":["'), F.when(F.length("text") % 3 == 0, "short").otherwise("long"), F.lit('"]}'),
    )
    return a.parquet("conversations").select(
        F.col("conv_id").alias("document_id"), F.col("turn").alias("page_no"), data.alias("data"),
        F.when(F.length("text") % 10 == 0, "timeout").alias("error"),
    )


query(
    "d12_merge_pages",
    "",
    """SELECT conv_id AS document_id, '/financials/total_amount' AS path, max_by(length(text), turn)::VARCHAR AS value FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, '/page', min_by(length(text), turn)::VARCHAR FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, '/line_items', '[' || string_agg(turn, ',' ORDER BY turn) || ']' FROM conversations GROUP BY 1
UNION ALL SELECT conv_id, '/vendor_details/company_name', '"' || coalesce(min_by('C' || length(text), turn) FILTER (turn % 2 = 1), '') || '"' FROM conversations GROUP BY 1
UNION ALL SELECT DISTINCT conv_id, unnest(['/vendor_details', '/financials']), '{}' FROM conversations""",
)(lambda a: mo.merge_pages(_pages(a)))

query(
    "d12_merged_objects",
    "",
    """SELECT conv_id AS document_id, max_by(length(text), turn)::VARCHAR AS total, '[' || string_agg(turn, ',' ORDER BY turn) || ']' AS items FROM conversations GROUP BY 1""",
)(
    lambda a: mo.assemble(mo.merge_pages(_pages(a))).select(
        "document_id", F.get_json_object("data", "$.financials.total_amount").alias("total"), F.get_json_object("data", "$.line_items").alias("items")
    )
)

query(
    "d12_page_errors",
    "",
    """SELECT document_id, string_agg(e, '|' ORDER BY e) AS errors, true AS requires_human_review FROM (SELECT DISTINCT conv_id AS document_id,
  CASE WHEN length(text) % 10 = 0 THEN 'Page ' || turn || ' failed to process: timeout' WHEN length(text) % 3 = 0 THEN 'short' ELSE 'long' END AS e FROM conversations) GROUP BY 1""",
)(
    lambda a: mo.page_errors(_pages(a)).select(
        "document_id", F.array_join("validation_errors", "|").alias("errors"), "requires_human_review"
    )
)

SCHEMA = '{"vendor":"","total_amount":0,"vat_registered":true,"line_items":[],"client":{}}'
query(
    "h15_ensure_structure",
    "archive",
    """, s AS (SELECT unnest(['vendor', 'total_amount', 'vat_registered', 'line_items', 'client', 'requires_human_review', 'validation_errors']) AS k,
  unnest(['null', '0', '0', '[]', '{}', 'false', '[]']) AS d)
SELECT id, string_agg(k || CASE WHEN list_contains(json_keys(extracted_data), k) THEN '' ELSE '=' || d END, ',' ORDER BY k) AS members
FROM (SELECT * FROM archive WHERE extracted_data IS NOT NULL), s GROUP BY 1""",
)(lambda a: _structured(a))


def _structured(a: Archive):
    docs = a.table("archive", heavy=True).filter("extracted_data IS NOT NULL")
    full = docs.select("id", "extracted_data", mo.ensure_structure(F.col("extracted_data"), F.lit(SCHEMA)).alias("full"))
    names = ["vendor", "total_amount", "vat_registered", "line_items", "client", "requires_human_review", "validation_errors"]
    # "null" shows a member that is there with a JSON null.
    obj = F.from_json("full", "map<string,variant>")
    shown = [
        F.concat(
            F.lit(k),
            F.when(F.array_contains(F.json_object_keys("extracted_data"), k), "").otherwise(
                F.concat(F.lit("="), F.to_json(F.try_element_at(obj, F.lit(k))))
            ),
        )
        for k in sorted(names)
    ]
    return full.select("id", F.array_join(F.array(*shown), ",").alias("members"))


_NESTED = """, v AS (SELECT id, extracted_data AS j, coalesce(extracted_data ->> '$.vendor_details.company_name', extracted_data ->> '$.vendor_name', '') <> '' AS named,
  TRY_CAST(extracted_data ->> '$.financials.subtotal' AS DOUBLE) AS sub, TRY_CAST(extracted_data ->> '$.financials.tax_amount' AS DOUBLE) AS tax,
  TRY_CAST(extracted_data ->> '$.financials.total_amount' AS DOUBLE) AS total FROM archive WHERE extracted_data IS NOT NULL),
i AS (SELECT id, list_filter([CASE WHEN abs(sub + tax - total) > 0.02 THEN 'Math mismatch: Subtotal(' || sub || ') + Tax(' || tax || ') != Total(' || total || ')' END,
  CASE WHEN NOT named THEN 'Missing Vendor Name' END], lambda x: x IS NOT NULL) AS issues FROM v)"""
for _name, _remote in (("h16_validate_extraction", False), ("h16_validate_remote", True)):
    query(
        _name,
        "archive",
        f"{_NESTED} SELECT id, len(issues) > 0 AS requires_human_review, array_to_string(issues, '|') AS validation_errors FROM i",
    )(
        lambda a, r=_remote: mo.validate_extraction(
            a.table("archive", heavy=True).filter("extracted_data IS NOT NULL"), "extracted_data", remote=r
        ).select("id", "requires_human_review", F.array_join("validation_errors", "|").alias("validation_errors"))
    )

query(
    "h19_clean_html_text",
    "",
    """SELECT page_id, trim(regexp_replace(regexp_replace('| Url | Id |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || url || ' | ' || page_id || ' |' || chr(10) || chr(10) || html, '<img[^>]*>', '', 'g'),
  '\\n\\s*\\n', chr(10) || chr(10), 'g'), E' \\n\\t\\r') AS cleaned FROM pages""",
)(
    lambda a: a.wide("pages").select(
        "page_id",
        mo.clean_html_text(
            F.concat(
                F.lit("<img src='a.png'><table>\n<tr><th>Url</th><th><b>Id</b></th></tr>\n<tr><td> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </td><td>"),
                F.col("page_id"), F.lit("</td></tr></table>\n \n\n"), F.col("html"),
            )
        ).alias("cleaned"),
    )
)

query(
    "b20_order_keys_by_schema",
    "archive",
    """SELECT id, array_to_string(list_concat(list_filter(['grand_total', 'totalAmount', 'vendor', 'line_items'], lambda k: list_contains(json_keys(extracted_data), k)),
  list_filter(json_keys(extracted_data), lambda k: k NOT IN ('grand_total', 'totalAmount', 'vendor', 'line_items'))), ',') AS keys FROM archive WHERE extracted_data IS NOT NULL""",
)(
    lambda a: a.table("archive", heavy=True)
    .filter("extracted_data IS NOT NULL")
    .select(
        "id",
        order_keys_by_schema(F.col("extracted_data"), F.lit('{"grand_total":0,"totalAmount":0,"vendor":"","line_items":[]}')).alias("data"),
    )
    .select("id", F.array_join(F.json_object_keys("data"), ",").alias("keys"))
)
