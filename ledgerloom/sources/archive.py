"""Archive tables derived from the star-schema parquet files.

Every table is one projection (rarely one aggregate) over a given parquet file.
The text is plain SQL that both Spark and the checking database accept, with
``{name}`` for the parquet table, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TENANT = "concat('t', CAST({key} % 25 AS STRING))"


def _tenant(key: str) -> str:
    return TENANT.replace("{key}", key)


# Media types by key, in the order of the CASE arms below.
_MIME = """CASE o_orderkey % 10
    WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/pdf'
    WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jpeg' WHEN 4 THEN 'image/tiff'
    WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN 6 THEN 'text/csv' WHEN 7 THEN 'text/plain'
    WHEN 8 THEN 'message/rfc822' ELSE 'application/xml' END"""

_AMOUNT = "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)"

# Three spellings of the same extraction result, plus rows without one.
_EXTRACTED = f"""CASE
    WHEN o_orderkey % 8 = 0 THEN NULL
    WHEN o_orderkey % 8 IN (1, 2) THEN concat('{{{{"vendor_name":"Vendor ', CAST(o_custkey % 50 AS STRING),
        '","invoice_no":"INV-', CAST(o_orderkey % 1000 AS STRING), '","grand_total":', {_AMOUNT},
        ',"currency":"USD","gst":"RM ', CAST(o_orderkey % 97 AS STRING), '.50","items":[]}}}}')
    WHEN o_orderkey % 8 IN (3, 4) THEN concat('{{{{"vendor":"Vendor ', CAST(o_custkey % 50 AS STRING),
        '","invoiceNumber":"', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('INV-', CAST(o_orderkey % 1000 AS STRING)) END,
        '","invoice_number":"ALT-', CAST(o_orderkey % 77 AS STRING), '","totalAmount":"', {_AMOUNT},
        '","currency":"  ","lineItems":[{{{{"description":"Widget","quantity":2,"unitPrice":"10.00","amount":"$ 20.00"}}}},{{{{"name":"Bolt","qty":1,"unit_price":5,"amount":5,"sub_items":[{{{{"description":"Nut","quantity":4,"unit_price":1.25,"amount":"5"}}}}]}}}}]}}}}')
    WHEN o_orderkey % 8 = 5 THEN concat('{{{{"vendor":', CAST(o_custkey % 50 AS STRING),
        ',"total_amount":0,"grand_total":"1,', CAST(100 + o_orderkey % 900 AS STRING), '.25","total":"7 units","notes":null}}}}')
    WHEN o_orderkey % 8 = 6 THEN concat('{{{{"vendor_details":{{{{"company_name":"Vendor ', CAST(o_custkey % 50 AS STRING),
        '"}}}},"financials":{{{{"subtotal":', CAST(o_orderkey % 500 AS STRING), ',"tax_amount":10,"total_amount":',
        CAST(o_orderkey % 500 + CASE WHEN o_orderkey % 5 = 0 THEN 11 ELSE 10 END AS STRING), '}}}},"line_items":"n/a"}}}}')
    ELSE concat('{{{{"supplier":"Vendor ', CAST(o_custkey % 50 AS STRING), '","date":"1998-01-02","po_ref":"P', CAST(o_orderkey AS STRING),
        '","products":[1,{{{{"item_description":"Gear","parent_quantity":3,"parent_total_amount":"9.99"}}}},{{{{}}}}]}}}}')
    END"""

_MONTH_NAME = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{m}'"
    for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), start=1)
) + " END"
_ISO_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_DUE_DATE = "CAST(CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS STRING)"
_KEY = "CAST(o_orderkey AS STRING)"

# {name} is a parquet table; {{ }} are literal braces.
TABLES: dict[str, str] = {
    "archive": f"""
SELECT o_orderkey AS id,
  {_tenant('o_custkey')} AS tenant_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'invoice' WHEN '2-HIGH' THEN 'receipt'
    WHEN '3-MEDIUM' THEN 'contract' WHEN '4-NOT SPECIFIED' THEN 'report' ELSE 'letter' END AS document_type,
  CASE WHEN o_orderkey % 13 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed'
    WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'needs_review' END AS status,
  concat('scan-', CAST(o_custkey % 40 AS STRING),
    CASE o_orderkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tar.gz' ELSE '' END) AS original_filename,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL
    ELSE concat('Order ', CAST(o_orderkey AS STRING), ' for customer ', CAST(o_custkey AS STRING)) END AS title,
  {_MIME} AS mime_type,
  CAST(floor(o_totalprice) AS BIGINT) AS size_bytes,
  concat('c', CAST(o_orderkey - CASE WHEN o_orderkey % 10 = 3 THEN 1 ELSE 0 END AS STRING)) AS checksum,
  o_orderdate + INTERVAL '1' SECOND * CAST(o_orderkey % 86400 AS INT) AS uploaded_at,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS document_date,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) END AS deleted_at,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('Vendor ', CAST(o_custkey % 50 AS STRING)) END AS vendor,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('INV-', CAST(o_orderkey % 1000 AS STRING)) END AS invoice_no,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS total_amount,
  CASE o_custkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'MYR' WHEN 2 THEN 'EUR' END AS currency,
  o_custkey AS uploaded_by,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 130 END AS correspondent_id,
  CASE WHEN o_orderkey % 10 = 1 THEN o_custkey % 60 END AS template_id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 25 END AS document_type_id,
  CAST(o_orderkey % 9 AS INT) AS page_count,
  o_orderkey % 2 = 0 AS has_text_layer,
  o_orderkey % 2 = 1 AS ocr_used,
  CASE WHEN o_orderkey % 2 = 1 THEN CAST(50 + o_orderkey % 50 AS DOUBLE) / 100 END AS ocr_confidence,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL
    ELSE concat({_tenant('o_custkey')}, '/thumbnails/', CAST(o_orderkey AS STRING), '.png') END AS thumbnail_key,
  concat({_tenant('o_custkey')}, '/docs/', CAST(o_orderkey AS STRING), '.bin') AS storage_key,
  {_EXTRACTED} AS extracted_data
FROM {{orders}}""",
    "tenants": """
SELECT concat('t', CAST(n_nationkey AS STRING)) AS tenant_id, n_name AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN 0
    ELSE CAST(n_nationkey AS BIGINT) * 30000 END AS llm_monthly_token_cap,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey AS INT) * 10 END AS trash_retention_days,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN TIMESTAMP '2002-01-31 18:00:00'
    ELSE TIMESTAMP '2002-01-30 00:00:00' END AS trash_last_purged_at,
  CAST(1000000 AS BIGINT) * (n_nationkey + 1) AS storage_used_bytes,
  CAST(40000000 AS BIGINT) * (n_nationkey % 5 + 1) AS storage_limit_bytes
FROM {nation}""",
    # Customers of one segment get ids that no order has, so that some documents have no uploader.
    "users": f"""
SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN -c_custkey ELSE c_custkey END AS id, {_tenant('c_custkey')} AS tenant_id, c_name AS full_name,
  concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@example.org') AS email,
  CASE WHEN c_acctbal > 8000 THEN 'admin' ELSE 'user' END AS role
FROM {{customer}}""",
    "document_types": """
SELECT CAST(n_nationkey AS BIGINT) AS id,
  CASE WHEN n_nationkey < 7 THEN NULL ELSE concat('t', CAST(n_nationkey AS STRING)) END AS tenant_id,
  CASE n_nationkey % 8 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'letter'
    WHEN 4 THEN 'form' WHEN 5 THEN 'statement' WHEN 6 THEN 'other' ELSE 'delivery note' END AS name,
  CASE n_nationkey % 3 WHEN 0 THEN 'cascade' WHEN 1 THEN 'paddle_qwen' END AS extraction_method,
  CASE WHEN n_nationkey % 4 = 3 THEN NULL ELSE concat('{{"vendor":"","total":0,"key_',
    CAST(n_nationkey AS STRING), '":"","_instruction":"read","_hints":[1]}}') END AS json_schema
FROM {nation}""",
    "templates": """
SELECT p_partkey AS id, concat('t', CAST(p_partkey % 25 AS STRING)) AS tenant_id,
  CAST(p_size % 25 AS BIGINT) AS document_type_id, p_name AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'promoted' WHEN 1 THEN 'candidate' ELSE 'disabled' END AS status,
  p_partkey % 10 = 0 AS is_default,
  CASE p_partkey % 4 WHEN 0 THEN 'cascade' WHEN 1 THEN 'paddle_qwen' WHEN 2 THEN 'vlm' END AS extraction_method,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(p_partkey % 1000 AS INT) AS created_at,
  CASE WHEN p_partkey % 7 = 0 THEN NULL
    WHEN p_partkey % 7 = 1 THEN concat('{{"a":1,"_rules":"r","_original_schema_str":"{{', replace(concat('#"zeta#":#"#",#"', lower(p_type), '#":0'), '#', chr(92)), '}}"}}')
    ELSE concat('{{"vendor_name":"","line_items":[],"', lower(p_type), '":"","_instruction":"x","_rules":"y","_prompt":"z"}}') END AS field_mappings
FROM {part}""",
    "tags": """
SELECT s_suppkey AS id, concat('t', CAST(s_suppkey % 25 AS STRING)) AS tenant_id, s_name AS name,
  CASE s_suppkey % 3 WHEN 0 THEN '#ff0000' WHEN 1 THEN '#00ff00' ELSE '#0000ff' END AS color,
  s_suppkey % 7 = 0 AS is_inbox_tag,
  CASE s_suppkey % 8 WHEN 0 THEN 'none' WHEN 1 THEN 'any' WHEN 2 THEN 'all' WHEN 3 THEN 'literal'
    WHEN 4 THEN 'regex' WHEN 5 THEN 'regex' WHEN 6 THEN 'fuzzy' ELSE 'any' END AS matching_algorithm,
  CASE s_suppkey % 8 WHEN 0 THEN 'the' WHEN 1 THEN ' eder  nicht ' WHEN 2 THEN 'The and of' WHEN 3 THEN 'of the'
    WHEN 4 THEN 'th[ae][a-z]+ing ' WHEN 5 THEN '(unclosed' WHEN 6 THEN 'the' ELSE '' END AS match,
  s_suppkey % 2 = 0 AS is_insensitive,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(s_suppkey % 50 AS INT) AS created_at
FROM {supplier}""",
    "document_tags": "SELECT DISTINCT l_orderkey AS document_id, l_suppkey AS tag_id FROM {lineitem}",
    "correspondents": """
SELECT s_suppkey AS id, concat('t', CAST(s_suppkey % 25 AS STRING)) AS tenant_id,
  CASE WHEN s_suppkey % 4 = 3 THEN concat('Vendor ', CAST(s_suppkey % 50 AS STRING)) ELSE s_name END AS name,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('billing', CAST(s_suppkey AS STRING), '@example.org') END AS email,
  CASE s_suppkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'any' WHEN 2 THEN 'literal' WHEN 3 THEN 'all' ELSE 'regex' END AS matching_algorithm,
  CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'zzz qqq' WHEN 2 THEN 'And The' WHEN 3 THEN 'the that' ELSE 'er(ing|ed) of' END AS match,
  s_suppkey % 2 = 1 AS is_insensitive,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(s_suppkey % 50 AS INT) AS created_at
FROM {supplier}""",
    # Likewise some fields get ids that no value has, so that some values have no field.
    "custom_fields": """
SELECT CASE WHEN p_partkey % 50 = 49 THEN -p_partkey ELSE p_partkey END AS id, concat('t', CAST(p_partkey % 25 AS STRING)) AS tenant_id,
  concat(p_brand, ' ', CAST(p_partkey AS STRING)) AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'number' WHEN 2 THEN 'date' WHEN 3 THEN 'boolean' ELSE 'select' END AS field_type,
  CAST(p_size AS INT) AS position
FROM {part}""",
    "field_values": """
SELECT l_orderkey AS document_id, l_partkey AS field_id,
  CASE l_partkey % 5 WHEN 0 THEN concat('"', l_returnflag, '-', CAST(CAST(l_quantity AS INT) AS STRING), '% Team"')
    WHEN 1 THEN CAST(CAST(l_quantity AS INT) AS STRING)
    WHEN 2 THEN concat('"', CAST(CAST(l_shipdate AS DATE) AS STRING), '"')
    WHEN 3 THEN CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END
    ELSE CASE WHEN l_returnflag = 'R' THEN '"Travel"' ELSE '"International Travel"' END END AS value,
  l_shipdate AS set_at, l_suppkey AS source_id, l_linenumber AS line_no
FROM {lineitem}""",
    "type_fields": """
SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract'
    WHEN 3 THEN 'report' ELSE 'letter' END AS document_type,
  concat('t', CAST((CASE WHEN p_partkey % 9 = 0 THEN p_partkey ELSE p_partkey % 60 END) % 25 AS STRING)) AS tenant_id,
  p_partkey % 60 AS field_id, p_partkey % 2 = 0 AS required, CAST(p_partkey % 4 AS INT) AS position
FROM {part}""",
    "activity": f"""
SELECT event_id AS id, {_tenant('user_id')} AS tenant_id,
  CASE event_type WHEN 'view' THEN 'search' WHEN 'signup' THEN 'user_added' WHEN 'error' THEN 'processing_failed'
    WHEN 'click' THEN 'download' ELSE 'upload' END AS type,
  user_id % 40 AS document_id, user_id, concat('user ', CAST(user_id AS STRING)) AS user_name, ts AS happened_at
FROM {{events}}""",
    "ai_usage": f"""
SELECT event_id AS id, {_tenant('user_id')} AS tenant_id, user_id AS document_id,
  CAST(floor(value * 70) AS BIGINT) AS prompt_tokens, CAST(floor(value * 30) AS BIGINT) AS completion_tokens,
  CAST(floor(value * 70) AS BIGINT) + CAST(floor(value * 30) AS BIGINT) AS total_tokens,
  CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL '20' DAY ELSE ts END AS created_at
FROM {{events}}""",
    "extractions": """
SELECT event_id AS id, user_id AS document_id,
  CASE event_type WHEN 'view' THEN 'deterministic' WHEN 'click' THEN 'manual' ELSE 'vlm' END AS method,
  CASE WHEN event_type = 'view' THEN NULL ELSE concat('model-', CAST(event_id % 3 AS STRING)) END AS model_name,
  value / 1000 AS confidence, ts AS created_at
FROM {events}""",
    "shares": """
SELECT event_id AS id, event_id % 7000 AS document_id, ts AS created_at,
  CAST(event_id % 45 - 5 AS INT) AS requested_days
FROM {events}""",
    "invoice_lines": """
SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS items_total,
  listagg(concat('Part ', CAST(l_partkey AS STRING), ' ', CAST(CAST(l_quantity AS INT) AS STRING), ' ',
    CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS STRING), '.00 ',
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING)), chr(10))
  WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS body
FROM {lineitem} GROUP BY l_orderkey""",
    # Invoice, receipt and other texts written out from orders and their lines.
    "rendered": f"""
SELECT o_orderkey AS id, o_custkey, o_orderdate, items_total, CASE o_orderkey % 8
  WHEN 0 THEN concat('Acme Trading ', CAST(o_custkey % 50 AS STRING), chr(10), 'TAX INVOICE', chr(10), 'Invoice No: INV-', {_KEY}, chr(10),
    'Invoice Date: ', {_ISO_DATE}, chr(10), 'Due Date: ', {_DUE_DATE}, chr(10), body, chr(10),
    'Subtotal: 1.00', chr(10), 'GRAND TOTAL: USD ', CAST(items_total AS STRING))
  WHEN 1 THEN concat('OFFICIAL RECEIPT', chr(10), 'Order by:', chr(10), 'Kedai ', CAST(o_custkey % 50 AS STRING), chr(10), 'Receipt # R', {_KEY}, chr(13), chr(10),
    'Date: ', CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING), chr(10),
    body, chr(10), 'Total RM ', CAST(items_total AS STRING))
  WHEN 2 THEN concat('QUOTE', chr(10), 'Quote number: ', {_KEY}, chr(10), 'Quote total: $500.00', chr(10), body)
  WHEN 3 THEN concat('INVOICE', chr(10), '12-34', chr(10), 'Globex', chr(10), 'INVOICE #', chr(10), {_KEY}, 'X', chr(10), 'Due Date: ', {_ISO_DATE}, chr(10),
    'Date: ', {_DUE_DATE}, chr(10), body, chr(10), 'Sub total 12.00', chr(10), 'Balance Due: ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), chr(10), 'EUR only')
  WHEN 4 THEN concat('INVOICE', chr(10), 'TERMS & CONDITIONS', chr(10), body)
  WHEN 5 THEN concat('Bill To: Client', chr(10), 'Umbrella Services', chr(10), 'Inv No. ', 'Scott', chr(10), 'Consulting services ', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING),
    chr(10), 'Sales tax 3.00', chr(10), 'Total Amount - $', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING))
  WHEN 6 THEN concat('Initech', chr(10), 'Invoice number: ', {_KEY}, '-A', chr(10), 'Date:', {_MONTH_NAME}, CAST(day(o_orderdate) AS STRING), ',', CAST(year(o_orderdate) AS STRING), chr(10),
    'DueDate: ', CAST(day(o_orderdate) AS STRING), ' ', {_MONTH_NAME}, ' ', CAST(year(o_orderdate) + 1 AS STRING), chr(10), 'Amount due 1,', CAST(100 + o_orderkey % 900 AS STRING), '.25')
  ELSE '   ' END AS text
FROM {{orders}} JOIN ({{invoice_lines}}) ON l_orderkey = o_orderkey""",
    # Extraction input: the rendered texts and the plain documents together.
    "corpus": """
SELECT id, concat('t', CAST(abs(id) % 25 AS STRING)) AS tenant_id,
  CASE abs(id) % 7 WHEN 3 THEN 'application/xml' WHEN 4 THEN 'text/plain' WHEN 5 THEN 'image/png' ELSE 'application/pdf' END AS mime_type,
  abs(id) % 2 = 0 AS has_text_layer, CASE WHEN abs(id) % 2 = 1 THEN CAST(50 + abs(id) % 50 AS DOUBLE) / 100 END AS ocr_confidence,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(abs(id) % 2500000 AS INT) AS uploaded_at,
  concat('upload ', CAST(id AS STRING)) AS title, text
FROM (SELECT id, text FROM ({rendered}) r UNION ALL SELECT -1 - doc_id, text FROM {documents}) u""",
    # UBL invoice XML written out from orders and their lines.
    "ubl": """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN concat('<!DOCTYPE x>', body) WHEN o_orderkey % 11 = 1 THEN concat(body, '<open>')
  WHEN o_orderkey % 11 = 2 THEN replace(body, 'Invoice-2"', 'Order-2"') ELSE body END AS xml
FROM (SELECT o_orderkey, concat('<?xml version="1.0"?>', chr(10), '<Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:cac="urn:cac" xmlns:cbc="urn:cbc">',
    '<cbc:ID> INV-', CAST(o_orderkey AS STRING), ' </cbc:ID><cbc:IssueDate>', CAST(CAST(o_orderdate AS DATE) AS STRING), '</cbc:IssueDate>',
    CASE WHEN o_orderkey % 3 = 0 THEN '<cbc:DueDate>soon</cbc:DueDate>' ELSE concat('<cbc:DueDate>', CAST(CAST(o_orderdate + INTERVAL '30' DAY AS DATE) AS STRING), '</cbc:DueDate>') END,
    '<cbc:DocumentCurrencyCode>MYR</cbc:DocumentCurrencyCode><cac:AccountingSupplierParty><cac:Party>',
    CASE WHEN o_orderkey % 2 = 0 THEN concat('<cac:PartyLegalEntity><cbc:RegistrationName>Legal ', CAST(o_custkey AS STRING), '</cbc:RegistrationName></cac:PartyLegalEntity>') ELSE '' END,
    '<cac:PartyName><cbc:Name>Trade ', CAST(o_custkey AS STRING), '</cbc:Name></cac:PartyName></cac:Party></cac:AccountingSupplierParty>', lines,
    '<cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="MYR">', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '</cbc:PayableAmount></cac:LegalMonetaryTotal></Invoice>') AS body
  FROM {orders} JOIN (SELECT l_orderkey, listagg(concat('<cac:InvoiceLine><cbc:InvoicedQuantity>', CAST(CAST(l_quantity AS INT) AS STRING), '</cbc:InvoicedQuantity>',
    CASE WHEN l_returnflag = 'R' THEN '' ELSE concat('<cbc:LineExtensionAmount>', CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '</cbc:LineExtensionAmount>') END,
    '<cac:Item><cbc:Name>Part ', CAST(l_partkey AS STRING), '</cbc:Name></cac:Item></cac:InvoiceLine>'), '')
    WITHIN GROUP (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS lines FROM {lineitem} GROUP BY l_orderkey) l ON l_orderkey = o_orderkey) x""",
    # Email texts: known and new senders in several written forms.
    "mails": """
SELECT o_orderkey AS id, concat('t', CAST(o_custkey % 25 AS STRING)) AS tenant_id, 'message/rfc822' AS mime_type,
  CAST(NULL AS BIGINT) AS correspondent_id, CAST(NULL AS STRING) AS title, CAST(NULL AS STRING) AS vendor,
  CASE o_orderkey % 7
    WHEN 0 THEN concat('From: "Desk ', CAST(o_custkey % 25 AS STRING), '" <Billing', CAST(o_custkey % 25 AS STRING), '@Example.org>', chr(10), 'Subject: hello')
    WHEN 1 THEN concat('From: Supplier#', lpad(CAST(o_custkey % 25 AS STRING), 9, '0'), ' <fresh', CAST(o_custkey % 75 AS STRING), '@example.org>', chr(10), chr(10), 'hi')
    WHEN 2 THEN concat('Subject: x', chr(10), 'From: new', CAST(o_custkey % 300 AS STRING), '@example.net')
    WHEN 3 THEN concat('From: sales', CAST(o_custkey % 40 AS STRING), '@example.com (Sales Team)')
    WHEN 4 THEN concat('From: Sales Team <team', CAST(o_orderkey % 90 AS STRING), '@example.com>')
    WHEN 5 THEN 'Subject: no sender here'
    ELSE concat('From: Someone Else', chr(10), 'the end') END AS text
FROM {orders}""",
    # Answers of the model by document: type, confidence, fields and tokens.
    "model_results": """
SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' ELSE 'other' END AS model_type,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS model_confidence,
  CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE concat('{{"vendor":"Model ', CAST(o_custkey % 50 AS STRING), '","invoice_number":"M-', CAST(o_orderkey AS STRING),
    '","grand_total":', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), ',"currency":"SGD"}}') END AS model_fields,
  CAST(100 + o_orderkey % 4000 AS BIGINT) AS total_tokens
FROM {orders}""",
    "texts": """
SELECT doc_id AS id, concat('t', CAST(doc_id % 25 AS STRING)) AS tenant_id,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE concat('Memo ', CAST(doc_id AS STRING), ' ', source) END AS title,
  concat(source, '-', CAST(doc_id % 90 AS STRING), '.', lang) AS original_filename,
  CASE lang WHEN 'en' THEN 'report' WHEN 'fr' THEN 'contract' ELSE 'letter' END AS document_type,
  CASE WHEN doc_id % 4 = 0 THEN 'completed' ELSE 'queued' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(doc_id % 5000000 AS INT) AS uploaded_at,
  CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS deleted_at,
  n_chars, text
FROM {documents}""",
}

PARQUET = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _expand(name: str) -> str:
    text = TABLES[name]
    while inner := re.search(r"\{(rendered|invoice_lines)\}", text):
        text = text.replace(inner.group(0), TABLES[inner.group(1)])
    return text


class Archive:
    """Lazy access to the archive tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str, partitions: int | None = None):
        """``partitions``: deal tables for heavy work into so many parts (files of one row group are not split)."""
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.partitions = partitions

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def wide(self, name: str) -> DataFrame:
        """A parquet table for work that is heavy per row, dealt anew if the caller asked for it."""
        rows = self.parquet(name)
        return rows.repartition(self.partitions) if self.partitions else rows

    def table(self, name: str, heavy: bool = False) -> DataFrame:
        text = _expand(name)
        read = self.wide if heavy else self.parquet
        used = {p: read(p) for p in PARQUET if "{" + p + "}" in text}
        return self.spark.sql(text, **used)


def duckdb_view(name: str) -> str:
    """The same table as SQL text over the registered parquet views."""
    text = _expand(name).format(**{p: p for p in PARQUET})
    return re.sub(r"listagg\((.*?)\)\s+WITHIN GROUP \((ORDER BY .*?)\)", r"string_agg(\1 \2)", text, flags=re.DOTALL)


def duckdb_with(names: list[str], body: str) -> str:
    """``WITH name AS (...), ... body`` for the checking database."""
    parts = [f"{n} AS ({duckdb_view(n)})" for n in names]
    return f"WITH {', '.join(parts)} {body}" if parts else body
