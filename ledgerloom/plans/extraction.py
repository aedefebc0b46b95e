"""Field extraction, gate, routing, chunks and evaluation (J, D13, D14, C18, H18-H21)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import extract as ex
from ..operators import gate as gt
from ..operators import routing as rt
from ..session import materialise
from ..sources.archive import Archive
from .registry import query

AS_OF = datetime.datetime(2024, 1, 31)

# -- checking SQL -------------------------------------------------------------

_AMT = r"[0-9][0-9,]*\.[0-9]{2}"
_GAP = r"\s*[:\-]?\s*\n?\s*"


def _total(label: str) -> str:
    pattern = rf"(?i){label}{_GAP}(?:MYR|USD|SGD|EUR|GBP|AUD|\$|RM)?\s*({_AMT})"
    return f"try_cast(replace(nullif(regexp_extract(plain, '{pattern}', 1), ''), ',', '') AS DOUBLE)"


_FORMATS = "['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%d %b %Y', '%b%d,%Y']"


def _dated(source: str, label: str) -> str:
    pattern = rf"(?i){label}{_GAP}([A-Za-z0-9 ,/\-]{{6,24}})"
    return f"CAST(try_strptime(trim(regexp_extract({source}, '{pattern}', 1)), {_FORMATS}) AS DATE)"


_STOP = " OR ".join(f"contains(lower(s), '{w}')" for w in ex.VENDOR_STOP_WORDS)
_ITEM_STOP = " OR ".join(f"contains(lower(regexp_extract(s, '^([A-Za-z][^0-9]{{2,60}}?)\\s+({_AMT})$', 1)), '{w}')" for w in ex.ITEM_STOP_WORDS)
_FULL = rf"^(.+?)\s+([0-9]+(?:\.[0-9]+)?)\s+({_AMT})\s+({_AMT})$"
_SHORT = rf"^([A-Za-z][^0-9]{{2,60}}?)\s+({_AMT})$"


def _num(expression: str) -> str:
    return f"try_cast(replace({expression}, ',', '') AS DOUBLE)"


def _word(code: str) -> str:
    return rf"regexp_matches(upper(text), '(^|[^\p{{L}}\p{{N}}_]){code}($|[^\p{{L}}\p{{N}}_])')"


_CURRENCY = "CASE " + " ".join(f"WHEN {_word(c)} THEN '{c}'" for c in ex.CURRENCY_CODES)
_CURRENCY += f" WHEN {_word('RM')} THEN 'MYR' " + " ".join(
    f"WHEN contains(text, '{s}') THEN '{c}'" for s, c in ex.CURRENCY_SYMBOLS
) + " END"

_CAND = f""", typed AS (SELECT *, CASE WHEN contains(lower(text), 'invoice') OR contains(lower(text), 'bill to') THEN 'invoice'
    WHEN contains(lower(text), 'receipt') OR contains(lower(text), 'payment received') THEN 'receipt' END AS document_type,
  regexp_replace(text, '(?i)sub\\s?total', '~~', 'g') AS plain, regexp_replace(text, '(?i)due\\s?date', '~~', 'g') AS nodue,
  list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda s: trim(s, E' \\t')), lambda s: s <> '') AS lines FROM corpus),
cand AS (SELECT *,
  list_filter(lines[1:8], lambda s: NOT ({_STOP}) AND length(s) BETWEEN 2 AND 60 AND NOT regexp_matches(s, '^[0-9\\s.,\\-/]+$') AND NOT ends_with(s, ':'))[1] AS vendor,
  nullif(regexp_extract(text, '(?i)(?:invoice|inv|receipt)\\s*(?:no\\.?|number|#){_GAP}([A-Za-z0-9][A-Za-z0-9\\-/]{{1,19}})', 1), '') AS invoice_number,
  coalesce({_dated('text', 'invoice' + chr(92) + 's*date')}, {_dated('nodue', chr(92) + 'bdate' + chr(92) + 'b')}) AS invoice_date,
  {_dated('text', 'due' + chr(92) + 's*date')} AS due_date,
  coalesce({', '.join(_total(x) for x in ('balance' + chr(92) + 's*due', 'grand' + chr(92) + 's*total', 'amount' + chr(92) + 's*due', 'total' + chr(92) + 's*amount', 'total'))}) AS total_amount,
  {_CURRENCY} AS currency,
  list_filter(list_transform(lines, lambda s: CASE WHEN regexp_matches(s, '{_FULL}') THEN
      {{'description': trim(regexp_extract(s, '{_FULL}', 1)), 'quantity': try_cast(regexp_extract(s, '{_FULL}', 2) AS DOUBLE),
        'unit_price': {_num(f"regexp_extract(s, '{_FULL}', 3)")}, 'amount': {_num(f"regexp_extract(s, '{_FULL}', 4)")}}}
    WHEN regexp_matches(s, '{_SHORT}') AND NOT ({_ITEM_STOP}) THEN
      {{'description': trim(regexp_extract(s, '{_SHORT}', 1)), 'quantity': 1.0::DOUBLE,
        'unit_price': {_num(f"regexp_extract(s, '{_SHORT}', 2)")}, 'amount': {_num(f"regexp_extract(s, '{_SHORT}', 2)")}}} END), lambda i: i IS NOT NULL) AS line_items
  FROM typed WHERE document_type IS NOT NULL)"""

GATE = f"""{_CAND}, sig AS (SELECT *,
  CASE WHEN vendor <> '' THEN least(1.0::DOUBLE, found + 0.1::DOUBLE) ELSE found END AS completeness,
  CASE WHEN applied = 0 THEN 0.5::DOUBLE ELSE met / applied END AS format_validity,
  coalesce(ocr_confidence, 1.0::DOUBLE) AS ocr_score,
  CASE WHEN total_amount IS NULL OR len(line_items) = 0 OR items = 0 OR abs(items - total_amount) <= greatest(1.0::DOUBLE, total_amount * 0.02::DOUBLE)
    THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS math_audit
FROM (SELECT *, ((invoice_number IS NOT NULL)::INT + (invoice_date IS NOT NULL OR due_date IS NOT NULL)::INT + (total_amount IS NOT NULL)::INT)::DOUBLE / 3 AS found,
  ((invoice_number IS NOT NULL)::INT + (total_amount IS NOT NULL)::INT + (invoice_date IS NOT NULL AND due_date IS NOT NULL)::INT)::DOUBLE AS applied,
  (coalesce(regexp_matches(invoice_number, '[0-9]'), false)::INT + coalesce(total_amount > 0, false)::INT + coalesce(due_date >= invoice_date, false)::INT)::DOUBLE AS met,
  list_sum(list_transform(line_items, lambda i: i.amount)) AS items FROM cand)),
scored AS (SELECT *, round(raw, 4) AS gate_score, raw >= 0.75::DOUBLE AS gate_passed FROM (SELECT *,
  completeness * 0.4::DOUBLE + format_validity * 0.2::DOUBLE + ocr_score * 0.2::DOUBLE + math_audit * 0.2::DOUBLE AS raw FROM sig))"""


def _candidates(a: Archive):
    return ex.extract_candidates(a.table("corpus", heavy=True)).filter("document_type IS NOT NULL")


def _scored(a: Archive):
    return gt.score_candidates(ex.extract_candidates(a.table("corpus", heavy=True)))


query("j01_candidate_type", "corpus", f"{_CAND} SELECT id, document_type FROM typed")(
    lambda a: a.table("corpus", heavy=True).select("id", ex.candidate_type(F.col("text")).alias("document_type"))
)

for _name, _column in (
    ("j02_invoice_number", "invoice_number"),
    ("j03_total_amount", "total_amount"),
    ("j05_currency", "currency"),
    ("j06_vendor", "vendor"),
):
    query(_name, "corpus", f"{_CAND} SELECT id, {_column} FROM cand")(
        lambda a, c=_column: _candidates(a).select("id", c)
    )

query("j04_dates", "corpus", f"{_CAND} SELECT id, invoice_date, due_date FROM cand")(
    lambda a: _candidates(a).select("id", "invoice_date", "due_date")
)

query(
    "j07_line_items",
    "corpus",
    f"""{_CAND} SELECT id, pos, i.description AS description, i.quantity AS quantity, i.unit_price AS unit_price, i.amount AS amount
FROM (SELECT id, unnest(line_items) AS i, generate_subscripts(line_items, 1) - 1 AS pos FROM cand)""",
)(lambda a: _candidates(a).select("id", F.posexplode("line_items").alias("pos", "i")).select("id", "pos", "i.*"))

query(
    "j08_extract_candidates",
    "corpus",
    f"""{_CAND} SELECT id, document_type, vendor, invoice_number, invoice_date, due_date, total_amount, currency, len(line_items) AS n_items FROM cand""",
)(
    lambda a: _candidates(a).select(
        "id", *[c for c in ex.CANDIDATE_FIELDS if c != "line_items"], F.size("line_items").alias("n_items")
    )
)

for _name, _columns in (
    ("j09_completeness", ["completeness"]),
    ("j10_format_validity", ["format_validity"]),
    ("j11_ocr", ["ocr_score"]),
    ("j12_math_audit", ["math_audit"]),
    ("j13_gate_score", ["gate_score", "gate_passed"]),
):
    query(_name, "corpus", f"{GATE} SELECT id, {', '.join(_columns)} FROM scored")(
        lambda a, c=_columns: _scored(a).filter("document_type IS NOT NULL").select("id", *c)
    )

query(
    "d13_line_item_audit",
    "archive",
    """SELECT a.id, CAST(s AS DOUBLE) AS items_total, n AS n_items, CASE WHEN n IS NULL OR a.total_amount IS NULL OR s = 0
  OR abs(s::DOUBLE - a.total_amount::DOUBLE) <= greatest(1.0, a.total_amount::DOUBLE * 0.02) THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS math_audit
FROM archive a LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = a.id""",
)(
    lambda a: gt.line_item_audit(
        a.table("archive").select("id", "total_amount"),
        a.parquet("lineitem").select(
            F.col("l_orderkey").alias("id"), F.col("l_extendedprice").cast("decimal(12,2)").alias("amount")
        ),
    ).select("id", F.col("items_total").cast("double").alias("items_total"), "n_items", "math_audit")
)

# -- routing --------------------------------------------------------------------

_ROUTE = f"""{GATE}, used AS (SELECT tenant_id, sum(total_tokens) AS u FROM ai_usage WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1),
queue AS (SELECT s.id, s.tenant_id, s.uploaded_at, coalesce(m.total_tokens, 0) AS tok FROM scored s LEFT JOIN model_results m USING (id)
  WHERE NOT gate_passed AND (mime_type = 'application/pdf' OR mime_type LIKE 'image/%')),
admitted AS (SELECT q.id, coalesce(t.llm_monthly_token_cap, 2000000) > 0 AND coalesce(u.u, 0) +
    coalesce(sum(tok) OVER (PARTITION BY q.tenant_id ORDER BY uploaded_at, q.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    < coalesce(t.llm_monthly_token_cap, 2000000) AS admitted
  FROM queue q LEFT JOIN tenants t ON t.tenant_id = q.tenant_id LEFT JOIN used u ON u.tenant_id = q.tenant_id)"""


def _admitted(a: Archive, scored):
    queued = scored.filter(rt.model_queue(scored)).select("id", "tenant_id", "uploaded_at")
    return rt.admit_model_calls(queued, a.table("model_results"), a.table("tenants"), a.table("ai_usage"), AS_OF)


query(
    "j14_model_budget",
    "corpus model_results tenants ai_usage",
    f"{_ROUTE} SELECT id, admitted FROM admitted",
)(lambda a: _admitted(a, _scored(a)))

query(
    "j14_route",
    "corpus model_results tenants ai_usage",
    f"""{_ROUTE}, d AS (SELECT c.id, c.tenant_id, c.title, c.mime_type, s.document_type, s.gate_passed, s.vendor, s.invoice_number, s.total_amount, s.currency,
  m.*, ad.admitted, c.mime_type IN ('application/pdf', 'image/png', 'application/xml') AND s.id IS NOT NULL AS attempted
  FROM corpus c LEFT JOIN scored s ON s.id = c.id LEFT JOIN model_results m ON m.id = c.id LEFT JOIN admitted ad ON ad.id = c.id),
e AS (SELECT *, attempted AND coalesce(gate_passed, false) AS by_rules FROM d),
f AS (SELECT *, attempted AND NOT by_rules AND mime_type <> 'application/xml' AS queued FROM e),
g AS (SELECT *, queued AND coalesce(admitted, false) AS called FROM f),
h AS (SELECT *, called AND model_fields IS NOT NULL AS answered, called AND model_fields IS NOT NULL AND model_confidence >= 0.7 AS by_model FROM g),
i AS (SELECT *, CASE WHEN by_rules THEN vendor WHEN answered THEN model_fields ->> '$.vendor' END AS v,
  CASE WHEN by_rules THEN invoice_number WHEN answered THEN model_fields ->> '$.invoice_number' END AS n FROM h)
SELECT id, tenant_id, CASE WHEN attempted AND NOT by_rules AND NOT by_model THEN 'needs_review' ELSE 'completed' END AS status,
  CASE WHEN NOT attempted THEN 'none' WHEN by_rules OR by_model THEN 'accepted' WHEN queued AND NOT called THEN 'skipped_budget' ELSE 'low_confidence' END AS extraction_status,
  CASE WHEN by_rules OR (attempted AND NOT queued) THEN 'deterministic' WHEN queued THEN 'vlm' END AS extraction_method,
  CASE WHEN by_rules THEN document_type WHEN answered THEN model_type END AS document_type, v AS vendor, n AS invoice_no,
  CASE WHEN by_rules THEN total_amount::DECIMAL(12,2) WHEN answered THEN CAST(model_fields ->> '$.grand_total' AS DECIMAL(12,2)) END AS total_amount,
  CASE WHEN by_rules THEN currency WHEN answered THEN model_fields ->> '$.currency' END AS currency,
  CASE WHEN (by_rules OR by_model) AND v <> '' AND n <> '' THEN v || ' — ' || n ELSE title END AS title FROM i""",
)(lambda a: _routed(a))


def _routed(a: Archive):
    # Used for the queue and for the decision: extract once, keep the small result.
    scored = materialise(a.spark, _scored(a).drop("text"), "scored")
    return rt.route(scored, a.table("model_results"), _admitted(a, scored)).drop("extracted_data")


query(
    "j15_reextract_route",
    "archive model_results tenants ai_usage",
    """, base AS (SELECT a.*, CASE WHEN id % 4 = 1 THEN NULL ELSE 'text' END AS extracted_text FROM archive a),
ok AS (SELECT t.tenant_id, coalesce(t.llm_monthly_token_cap, 2000000) > 0 AND coalesce(u.used, 0) < coalesce(t.llm_monthly_token_cap, 2000000) AS allowed
  FROM tenants t LEFT JOIN (SELECT tenant_id, sum(total_tokens) AS used FROM ai_usage WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1) u USING (tenant_id)),
j AS (SELECT b.*, m.model_type, m.model_confidence, m.model_fields, (extracted_text <> '' IS TRUE OR status = 'completed') AND
  (mime_type = 'application/pdf' OR mime_type LIKE 'image/%') AND allowed AND m.model_fields IS NOT NULL AS changed
  FROM base b LEFT JOIN model_results m USING (id) JOIN ok USING (tenant_id))
SELECT id, CASE WHEN changed AND model_confidence >= 0.7 AND status = 'needs_review' THEN 'completed' ELSE status END AS status,
  CASE WHEN changed THEN model_type ELSE document_type END AS document_type, CASE WHEN changed THEN model_fields ->> '$.vendor' ELSE vendor END AS vendor,
  CASE WHEN changed THEN CAST(model_fields ->> '$.grand_total' AS DECIMAL(12,2)) ELSE total_amount END AS total_amount FROM j""",
)(lambda a: _reextracted(a))


def _reextracted(a: Archive):
    text = F.when(F.col("id") % 4 == 1, F.lit(None)).otherwise(F.lit("text"))
    docs = a.table("archive").withColumn("extracted_text", text)
    allowed = agg.budget_allowed(a.table("tenants"), a.table("ai_usage"), AS_OF)
    admitted = docs.select("id", "tenant_id").join(allowed, "tenant_id").select("id", F.col("allowed").alias("admitted"))
    out = rt.reextract_route(docs, a.table("model_results"), admitted)
    return out.select("id", "status", "document_type", "vendor", "total_amount")


_CHUNKED = f""", lines AS (SELECT doc_id, n_chars, text, unnest(regexp_extract_all(text, '[^\\n\\r]*(?:\\r\\n|[\\n\\r])|[^\\n\\r]+')) AS line,
  generate_subscripts(regexp_extract_all(text, '[^\\n\\r]*(?:\\r\\n|[\\n\\r])|[^\\n\\r]+'), 1) AS n FROM documents WHERE length(text) > {ex.CHUNK_CHARS}),
walk(doc_id, n, chunk_no, size) AS (SELECT doc_id, n, 0, length(line) FROM lines WHERE n = 1
  UNION ALL SELECT l.doc_id, l.n, CASE WHEN w.size > 0 AND w.size + length(l.line) > {ex.CHUNK_CHARS} THEN w.chunk_no + 1 ELSE w.chunk_no END,
    CASE WHEN w.size > 0 AND w.size + length(l.line) > {ex.CHUNK_CHARS} THEN length(l.line) ELSE w.size + length(l.line) END
  FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.n = w.n + 1),
pieces AS (SELECT doc_id AS id, w.chunk_no, string_agg(l.line, '' ORDER BY l.n) AS chunk FROM walk w JOIN lines l USING (doc_id, n) GROUP BY 1, 2
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= {ex.CHUNK_CHARS})"""
_CHUNKS_SQL = f"WITH RECURSIVE {_CHUNKED.lstrip(', ')}"

query("h18_chunk_text", "", f"{_CHUNKS_SQL} SELECT id, chunk_no, chunk FROM pieces")(
    lambda a: ex.chunk_table(a.wide("documents").select(F.col("doc_id").alias("id"), "text"), max_chunks=None)
)

query(
    "j16_model_work_list",
    "",
    f"""{_CHUNKS_SQL}, t AS (SELECT doc_id AS id, doc_id % 3 <> 0 AND length(trim(text)) >= 8 AS is_text FROM documents)
SELECT id, 'vision' AS mode, 0 AS chunk_no, 'vision' AS call FROM t WHERE NOT is_text
UNION ALL SELECT id, 'text', chunk_no, 'header' FROM pieces JOIN t USING (id) WHERE is_text AND chunk_no = 0
UNION ALL SELECT id, 'text', chunk_no, 'items' FROM pieces JOIN t USING (id) WHERE is_text""",
)(
    lambda a: ex.model_work_list(
        a.wide("documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") % 3 != 0).alias("has_text_layer")),
        max_calls=None,
    ).drop("chunk")
)

query(
    "h20_usable_text",
    "",
    """SELECT doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= greatest(16, 8 * greatest(doc_id % 900, 1)) AS usable FROM documents""",
)(
    lambda a: a.wide("documents").select(
        "doc_id", ex.usable_text(F.col("text"), F.col("doc_id") % 900).alias("usable")
    )
)

query(
    "h21_document_date",
    "corpus",
    """SELECT id, CASE WHEN d <= DATE '2002-12-31' AND year(d) >= 1949 THEN d END AS document_date FROM (SELECT id, CASE
  WHEN t ~ '^[0-9]{4}-' THEN try_cast(t AS DATE)
  ELSE CAST(try_strptime(t, ['%m/%d/%Y', '%d/%m/%Y', '%d %b %Y', '%b%d,%Y']) AS DATE) END AS d FROM (
  SELECT id, regexp_extract(text, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|\\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|\\b[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}|[A-Z][a-z]{2}[0-9]{1,2},[0-9]{4}') AS t FROM corpus))""",
)(
    lambda a: a.table("corpus", heavy=True).select(
        "id", ex.document_date(F.col("text"), datetime.date(2002, 12, 28), char_cap=None).alias("document_date")
    )
)

# -- evaluation -------------------------------------------------------------------

_LONG = """, actual AS (SELECT id AS document, unnest(['vendor', 'currency', 'total']) AS field,
  unnest([vendor, currency, CAST(total_amount::DECIMAL(14,2) AS VARCHAR)]) AS value FROM cand),
golden AS (SELECT o_orderkey AS document, unnest(['vendor', 'currency', 'total']) AS field,
  unnest([concat('Kedai ', o_custkey % 50), 'MYR', CAST(CAST(items_total AS DECIMAL(14,2)) AS VARCHAR)]) AS value FROM (SELECT *, id AS o_orderkey FROM rendered))"""


def _long(df, document: str, **fields):
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])
    return df.select(F.col(document).alias("document"), F.inline(pairs))


@query(
    "c18_evaluate_against_golden",
    "corpus rendered",
    f"""{_CAND}{_LONG} SELECT coalesce(a.document, g.document) AS document, coalesce(a.field, g.field) AS field, a.value AS actual, g.value AS expected,
  CASE WHEN a.value IS NOT DISTINCT FROM g.value THEN 'OK' ELSE 'DIFF' END AS verdict
FROM actual a FULL JOIN golden g ON a.document = g.document AND a.field = g.field""",
)
def c18(a: Archive):
    money = lambda c: F.col(c).cast("decimal(14,2)").cast("string")
    actual = _long(_candidates(a), "id", vendor=F.col("vendor"), currency=F.col("currency"), total=money("total_amount"))
    golden = _long(
        a.table("rendered"),
        "id",
        vendor=F.concat(F.lit("Kedai "), F.col("o_custkey") % 50),
        currency=F.lit("MYR"),
        total=money("items_total"),
    )
    return rt.evaluate_against_golden(actual, golden)


query(
    "d14_evaluation_rates",
    "corpus",
    f"""{GATE} SELECT count(*) AS total, count(s.id) AS candidates, count(*) FILTER (gate_passed) AS passed,
  count(*) FILTER (gate_passed) * 100.0::DOUBLE / count(s.id) AS pass_rate, (count(s.id) - count(*) FILTER (gate_passed)) * 100.0::DOUBLE / count(*) AS model_share
FROM corpus c LEFT JOIN scored s ON s.id = c.id""",
)(
    lambda a: agg.evaluation_rates(
        _scored(a).select(F.col("document_type").isNotNull().alias("is_candidate"), "gate_passed")
    )
)
