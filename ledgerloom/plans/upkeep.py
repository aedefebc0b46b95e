"""Match rules, senders and state-table maintenance (H1-H4, C13-C15, E2, K)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import maintain as mt
from ..operators import normalize as nz
from ..operators import rules as ru
from ..operators.audit import AuditLog
from ..operators.search_index import SearchIndex
from ..session import materialise, shared_folder
from ..sources.archive import Archive
from ..sources.catalog import Catalog
from .registry import query

AS_OF = datetime.datetime(2002, 1, 31, 18, 0)

# Rules are evaluated over whole texts here.
_HIT = """CASE WHEN {r}.matching_algorithm = 'none' OR {r}.match = '' THEN false
  WHEN {r}.matching_algorithm = 'any' THEN len(list_filter(string_split_regex({p}, '\\s+'), lambda w: w <> '' AND contains({t}, w))) > 0
  WHEN {r}.matching_algorithm = 'all' THEN len(list_filter(string_split_regex({p}, '\\s+'), lambda w: w <> '')) > 0
    AND len(list_filter(string_split_regex({p}, '\\s+'), lambda w: w <> '' AND NOT contains({t}, w))) = 0
  WHEN {r}.matching_algorithm = 'literal' THEN contains({t}, {p})
  WHEN {r}.matching_algorithm = 'regex' AND {r}.match NOT LIKE '(unclosed%' THEN
    CASE WHEN {r}.is_insensitive THEN regexp_matches(d.body, '(?i)' || {r}.match) ELSE regexp_matches(d.body, {r}.match) END
  ELSE false END"""


def _hit_sql(rule: str) -> str:
    return _HIT.format(
        r=rule,
        p=f"CASE WHEN {rule}.is_insensitive THEN lower({rule}.match) ELSE {rule}.match END",
        t=f"CASE WHEN {rule}.is_insensitive THEN lower(d.body) ELSE d.body END",
    )


_BODY = """, d AS (SELECT *, coalesce(title, '') || ' ' || coalesce(text, '') AS body, CASE WHEN id % 3 = 0 THEN ' SUPPLIER#' || lpad((id % 25)::VARCHAR, 9, '0') || ' '
  WHEN id % 3 = 1 THEN 'vendor ' || (id % 50) END AS vendor FROM texts WHERE deleted_at IS NULL)"""


def _texts(a: Archive):
    vendor = F.when(
        F.col("id") % 3 == 0, F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("id") % 25).cast("string"), 9, "0"), F.lit(" "))
    ).when(F.col("id") % 3 == 1, F.concat(F.lit("vendor "), (F.col("id") % 50).cast("string")))
    return a.table("texts", heavy=True).filter("deleted_at IS NULL").withColumn("vendor", vendor)


query(
    "h01_rule_matches",
    "texts tags",
    f"""{_BODY} SELECT d.id AS document_id, t.id AS tag_id FROM d JOIN tags t ON t.tenant_id = d.tenant_id WHERE {_hit_sql('t')}""",
)(lambda a: ru.match_tags(_texts(a), a.table("tags"), cap=None))

query(
    "h02_rule_text",
    "texts",
    "SELECT id, left(coalesce(title, '') || ' ' || text, 5000) AS rule_text, length(coalesce(title, '') || ' ' || text) AS full_length FROM texts",
)(
    lambda a: a.table("texts").select(
        "id",
        ru.rule_text(F.col("title"), F.col("text"), cap=5000).alias("rule_text"),
        F.length(ru.rule_text(F.col("title"), F.col("text"), None)).alias("full_length"),
    )
)

_SENDER = """, line AS (SELECT *, trim(regexp_extract(text, '(?m)^From:\\s*([^\\n]+)', 1)) AS l FROM mails),
parsed AS (SELECT *, nullif(CASE WHEN contains(l, '<') THEN trim(replace(regexp_extract(l, '^([^<]*)<', 1), '"', ''))
  WHEN contains(l, '(') THEN regexp_extract(l, '\\((.*)\\)', 1) END, '') AS sname,
  lower(nullif(CASE WHEN contains(l, '<') THEN regexp_extract(l, '<(.*)>', 1) ELSE regexp_extract(l, '^([^\\s]+)', 1) END, '')) AS semail FROM line)"""
query("h03_parse_sender", "mails", f"{_SENDER} SELECT id, sname AS name, semail AS email FROM parsed")(
    lambda a: a.table("mails", heavy=True).select("id", ru.parse_sender(F.col("text")).alias("s")).select("id", "s.name", "s.email")
)

query(
    "h04_vendor_name_hit",
    "texts correspondents",
    f"""{_BODY} SELECT d.id, c.id AS correspondent_id FROM d JOIN correspondents c ON lower(trim(d.vendor)) = lower(c.name) AND c.tenant_id = d.tenant_id""",
)(
    lambda a: ru.vendor_name_hits(_texts(a), a.table("correspondents"))
)

query(
    "c13_rule_match_join",
    "texts tags",
    f"""{_BODY} SELECT t.id AS tag_id, count(*) AS n_documents FROM d JOIN tags t ON t.tenant_id = d.tenant_id WHERE {_hit_sql('t')} GROUP BY 1""",
)(
    lambda a: ru.match_tags(_texts(a), a.table("tags"), cap=None).groupBy("tag_id").agg(F.count("*").alias("n_documents"))
)

_FIRST = f"""SELECT d.id, min_by(c.id, (c.created_at, c.id)) AS correspondent_id FROM d JOIN correspondents c ON c.tenant_id = d.tenant_id
WHERE c.matching_algorithm <> 'none' AND c.match <> '' AND (coalesce(lower(trim(d.vendor)) = lower(c.name), false) OR {_hit_sql('c')}) GROUP BY 1"""
query("e02_first_matching_rule", "texts correspondents", f"{_BODY} {_FIRST}")(
    lambda a: ru.match_correspondents(_texts(a), a.table("correspondents"), cap=None)
)

_LINKS = f"""{_SENDER}, s AS (SELECT id, tenant_id, semail AS email, trim(coalesce(sname, semail)) AS display FROM parsed WHERE semail IS NOT NULL),
k AS (SELECT s.*, (SELECT min(c.id) FROM correspondents c WHERE c.tenant_id = s.tenant_id AND c.email = s.email) AS email_id,
  n.id AS name_id, n.email AS name_email FROM s LEFT JOIN (SELECT * FROM correspondents QUALIFY row_number() OVER (PARTITION BY tenant_id, name ORDER BY id) = 1) n
  ON n.tenant_id = s.tenant_id AND n.name = s.display),
claim AS (SELECT * FROM k WHERE email_id IS NULL AND (name_id IS NULL OR name_email IS NULL)
  QUALIFY row_number() OVER (PARTITION BY tenant_id, display ORDER BY id) = 1),
owner AS (SELECT * FROM claim QUALIFY row_number() OVER (PARTITION BY tenant_id, email ORDER BY id) = 1),
links AS (SELECT k.id, k.tenant_id, k.email, CASE WHEN k.email_id IS NOT NULL THEN k.email_id WHEN o.id IS NOT NULL THEN o.name_id ELSE k.name_id END AS correspondent_id,
  CASE WHEN k.email_id IS NOT NULL THEN NULL WHEN o.id IS NOT NULL THEN CASE WHEN o.name_id IS NULL THEN o.display END WHEN k.name_id IS NULL THEN k.display END AS new_name,
  CASE WHEN k.email_id IS NULL AND o.id IS NOT NULL THEN k.email END AS fill_email
  FROM k LEFT JOIN owner o ON o.tenant_id = k.tenant_id AND o.email = k.email)"""


def _links(a: Archive):
    parsed = a.table("mails", heavy=True).select("id", "tenant_id", ru.parse_sender(F.col("text")).alias("s"))
    senders = parsed.select("id", "tenant_id", "s.name", "s.email").filter("email IS NOT NULL")
    return ru.link_senders(materialise(a.spark, senders, "senders"), a.table("correspondents"))


query(
    "c15_sender_link",
    "mails correspondents",
    f"{_LINKS} SELECT id, tenant_id, email, correspondent_id, new_name, fill_email FROM links",
)(_links)

query(
    "c15_new_correspondents",
    "mails correspondents",
    f"""{_LINKS} SELECT tenant_id, new_name AS name, coalesce(min(fill_email), min_by(email, id)) AS email FROM links
WHERE new_name IS NOT NULL GROUP BY ALL""",
)(lambda a: ru.new_correspondents(_links(a)))


def _assignable(a: Archive):
    plain = _texts(a).select(
        (-1 - F.col("id")).alias("id"), "tenant_id", F.lit("text/plain").alias("mime_type"),
        F.when(F.col("id") % 5 == 0, F.lit(1)).cast("bigint").alias("correspondent_id"), "title", "vendor", "text",
    )
    return plain.unionByName(a.table("mails", heavy=True))


query(
    "c14_assign_correspondent",
    "texts mails correspondents",
    f"""{_LINKS}, plain AS (SELECT -1 - id AS id, tenant_id, title, text, CASE WHEN id % 3 = 0 THEN ' SUPPLIER#' || lpad((id % 25)::VARCHAR, 9, '0') || ' '
    WHEN id % 3 = 1 THEN 'vendor ' || (id % 50) END AS vendor FROM texts WHERE deleted_at IS NULL AND id % 5 <> 0
  UNION ALL SELECT id, tenant_id, title, text, vendor FROM parsed WHERE semail IS NULL),
d AS (SELECT *, coalesce(title, '') || ' ' || coalesce(text, '') AS body FROM plain)
SELECT id, correspondent_id, new_name, 'sender' AS source FROM links
UNION ALL SELECT id, correspondent_id, NULL, 'rule' FROM ({_FIRST})""",
)(lambda a: ru.assign_correspondent(_assignable(a), a.table("correspondents"), cap=None))

query(
    "k12_apply_rules_to_existing",
    "texts tags",
    f"""{_BODY} SELECT d.id AS document_id, t.id AS tag_id FROM d JOIN tags t ON t.tenant_id = d.tenant_id WHERE {_hit_sql('t')}
UNION SELECT id, id % 10 FROM texts WHERE id % 2 = 0""",
)(lambda a: _reapplied(a))


def _reapplied(a: Archive):
    docs = _texts(a).withColumns(
        {"mime_type": F.lit("text/plain"), "correspondent_id": F.lit(None).cast("bigint")}
    )
    bridge = a.table("texts").filter("id % 2 = 0").select(F.col("id").alias("document_id"), (F.col("id") % 10).alias("tag_id"))
    return ru.apply_rules_to_existing(docs, a.table("tags"), a.table("correspondents"), bridge, cap=None)[0]


query(
    "f07_backfill_totals",
    "archive",
    "SELECT count(*) AS total, min(uploaded_at) AS oldest FROM archive WHERE deleted_at IS NULL",
)(
    lambda a: a.table("archive")
    .filter("deleted_at IS NULL")
    .agg(F.count("*").alias("total"), F.min("uploaded_at").alias("oldest"))
)

# -- state tables -----------------------------------------------------------------


def _ids(a: Archive):
    """Documents picked for a bulk edit: those with a large returned line."""
    return a.parquet("lineitem").filter("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_orderkey").alias("id"))


_IDS = "(SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)"
_T = "TIMESTAMP '2002-01-31 18:00:00'"

query(
    "k01_bulk_trash",
    "archive",
    f"SELECT id, CASE WHEN deleted_at IS NULL AND id IN {_IDS} THEN {_T} ELSE deleted_at END AS deleted_at FROM archive",
)(lambda a: mt.split_changed(mt.bulk_trash(a.table("archive"), _ids(a), AS_OF))[0].select("id", "deleted_at"))

query(
    "k01_restore",
    "archive",
    f"SELECT id, CASE WHEN id IN {_IDS} THEN NULL ELSE deleted_at END AS deleted_at FROM archive",
)(lambda a: mt.split_changed(mt.bulk_restore(a.table("archive"), _ids(a)))[0].select("id", "deleted_at"))

query(
    "a12_append_activity",
    "archive",
    f"""SELECT tenant_id, 'trash' AS type, id AS document_id, original_filename AS document_name, 7 AS user_id, 'Ana' AS user_name, {_T} AS happened_at
FROM archive WHERE deleted_at IS NULL AND id IN {_IDS}""",
)(
    lambda a: mt.activity(
        mt.split_changed(mt.bulk_trash(a.table("archive"), _ids(a), AS_OF))[1], "trash", AS_OF, 7, "Ana"
    ).drop("meta")
)

query(
    "k02_bulk_tag_assign",
    "document_tags",
    f"SELECT document_id, tag_id FROM document_tags UNION SELECT l_orderkey, 3 FROM (SELECT unnest(list(DISTINCT l_orderkey)) AS l_orderkey FROM {_IDS})",
)(lambda a: mt.bulk_tag_assign(a.table("document_tags"), _ids(a), 3))

query(
    "k02_bulk_tag_remove",
    "document_tags",
    f"SELECT document_id, tag_id FROM document_tags WHERE NOT (tag_id = 3 AND document_id IN {_IDS})",
)(lambda a: mt.bulk_tag_remove(a.table("document_tags"), _ids(a), 3))

query(
    "k03_bulk_set_type",
    "archive",
    f"SELECT id, CASE WHEN id IN {_IDS} THEN 'form' ELSE document_type END AS document_type FROM archive",
)(lambda a: mt.split_changed(mt.bulk_set_type(a.table("archive"), _ids(a), "form"))[0].select("id", "document_type"))

_EXPIRED = f""", due AS (SELECT *, coalesce(trash_retention_days, 30) AS days FROM tenants WHERE trash_last_purged_at IS NULL OR {_T} - trash_last_purged_at >= INTERVAL '24' HOUR),
purged AS (SELECT a.*, d.days FROM archive a JOIN due d USING (tenant_id) WHERE deleted_at < {_T} - INTERVAL '1' DAY * d.days)"""


def _purge(a: Archive):
    return mt.purge_expired(a.table("archive"), a.table("tenants"), AS_OF)


query("k04_purge_expired_kept", "archive tenants", f"{_EXPIRED} SELECT id FROM archive WHERE id NOT IN (SELECT id FROM purged)")(
    lambda a: _purge(a)["kept"].select("id")
)
query(
    "k04_purge_expired_tenants",
    "archive tenants",
    f"""{_EXPIRED} SELECT t.tenant_id, coalesce(p.b, 0)::BIGINT AS freed_bytes, greatest(storage_used_bytes - coalesce(p.b, 0), 0)::BIGINT AS storage_used_bytes,
  CASE WHEN t.tenant_id IN (SELECT tenant_id FROM due) THEN {_T} ELSE trash_last_purged_at END AS trash_last_purged_at
FROM tenants t LEFT JOIN (SELECT tenant_id, sum(size_bytes) AS b FROM purged GROUP BY 1) p USING (tenant_id)""",
)(
    lambda a: _purge(a)["tenants"].select("tenant_id", "freed_bytes", "storage_used_bytes", "trash_last_purged_at")
)
query(
    "d15_purge_summary",
    "archive tenants",
    f"""{_EXPIRED} SELECT tenant_id, 'permanent_delete' AS type, 'system' AS user_name, count(*) AS purged,
  'Auto-purged ' || count(*) || ' document(s) past the ' || days || '-day retention period' AS meta FROM purged GROUP BY tenant_id, days""",
)(lambda a: _purge(a)["events"])
query(
    "k15_orphaned_keys",
    "archive tenants",
    f"""{_EXPIRED} SELECT id, storage_key FROM purged WHERE storage_key IS NOT NULL UNION ALL SELECT id, thumbnail_key FROM purged WHERE thumbnail_key IS NOT NULL""",
)(lambda a: mt.orphaned_keys(_purge(a)["purged"]))

query(
    "k06_empty_trash",
    "archive tenants",
    """SELECT tenant_id, coalesce(p.b, 0)::BIGINT AS freed_bytes, greatest(storage_used_bytes - coalesce(p.b, 0), 0)::BIGINT AS storage_used_bytes
FROM tenants LEFT JOIN (SELECT tenant_id, sum(size_bytes) AS b FROM archive WHERE deleted_at IS NOT NULL GROUP BY 1) p USING (tenant_id)""",
)(lambda a: mt.empty_trash(a.table("archive"), a.table("tenants"))["tenants"])

query(
    "k07_permanent_delete",
    "archive",
    f"SELECT id, status FROM archive WHERE NOT (deleted_at IS NOT NULL AND id IN {_IDS})",
)(lambda a: mt.permanent_delete(a.table("archive"), _ids(a), a.table("tenants"))["kept"].select("id", "status"))


def _patches(a: Archive):
    """Edits derived from the customers: one per fifth of the documents' keys."""
    key = F.col("c_custkey")
    some = lambda n: F.when(key % n != 0, True)
    return a.parquet("customer").select(
        key.alias("id"),
        F.filter(
            F.array(F.lit("title"), F.when(some(2), F.lit("document_type")), F.when(some(3), F.lit("document_date")),
                    F.when(some(5), F.lit("correspondent_id")), F.lit("data_patch")),
            lambda x: x.isNotNull(),
        ).alias("keys"),
        F.when(key % 4 != 0, F.col("c_name")).alias("title"),
        F.lit("form").alias("document_type"),
        F.lit(None).cast("date").alias("document_date"),
        (key % 9).alias("correspondent_id"),
        F.when(key % 7 != 0, F.concat(F.lit('{"vendor":"'), F.col("c_name"), F.lit('"}'))).alias("data_patch"),
    )


query(
    "k08_patch_documents",
    "archive",
    """SELECT a.id, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE title END AS title, CASE WHEN c_custkey % 2 <> 0 THEN 'form' ELSE document_type END AS document_type,
  CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE document_date END AS document_date, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 9 ELSE correspondent_id END AS correspondent_id,
  CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE extracted_data ->> '$.vendor' END AS vendor, coalesce(c_custkey % 4 <> 0, false) AS reindex
FROM archive a LEFT JOIN customer ON c_custkey = a.id""",
)(
    lambda a: mt.patch_documents(a.table("archive"), _patches(a)).select(
        "id", "title", "document_type", "document_date", "correspondent_id",
        F.get_json_object("extracted_data", "$.vendor").alias("vendor"), "reindex",
    )
)


def _value_updates(a: Archive):
    order = F.struct("set_at", "source_id", "line_no", F.col("value").alias("tie"))
    return a.table("field_values").select("document_id", "field_id", "value", order.alias("seq"))


query(
    "k09_upsert_field_values",
    "field_values archive",
    """, existing AS (SELECT id AS document_id, id % 100 AS field_id, '"old"' AS value FROM archive),
newest AS (SELECT document_id, field_id, value FROM field_values QUALIFY row_number() OVER (PARTITION BY document_id, field_id ORDER BY set_at DESC, source_id DESC, line_no DESC, value DESC) = 1)
SELECT * FROM (SELECT document_id, field_id, value FROM newest UNION ALL SELECT * FROM existing e WHERE NOT EXISTS (
  SELECT 1 FROM newest n WHERE n.document_id = e.document_id AND n.field_id = e.field_id))
WHERE NOT (document_id, field_id) IN (SELECT (id, id % 100) FROM archive WHERE status = 'failed')""",
)(
    lambda a: mt.upsert_field_values(
        a.table("archive").select(
            F.col("id").alias("document_id"), (F.col("id") % 100).alias("field_id"), F.lit('"old"').alias("value")
        ),
        _value_updates(a),
        a.table("archive").filter("status = 'failed'").select(F.col("id").alias("document_id"), (F.col("id") % 100).alias("field_id")),
    )
)


def _uploads(a: Archive):
    k = lambda n, base=0: (F.col("id") % n + base).cast("string")
    return a.table("archive").select(
        "id",
        "tenant_id",
        "document_type",
        F.when(F.col("id") % 4 == 0, "not json")
        .otherwise(F.concat(F.lit('{"'), k(60), F.lit('":"v'), k(7), F.lit('","bad":1,"'), k(90, 60), F.lit('":'), k(11), F.lit("}")))
        .alias("field_values"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit('[{"fieldId":'), k(40), F.lit(',"value":true},{"x":1}]'))).alias("attach_fields"),
        F.concat(F.lit('[{"name":"Extra '), k(20), F.lit('","fieldType":"text","value":"n'), k(5), F.lit('"},{"name":"Odd","fieldType":"list"}]')).alias("new_fields"),
    )


def _upload_parts(a: Archive):
    return mt.upload_time_fields(_uploads(a), a.table("custom_fields"), a.table("type_fields"))


query(
    "k10_upload_time_values",
    "archive custom_fields",
    """, plain AS (SELECT id AS document_id, tenant_id, id % 60 AS field_id, '"v' || (id % 7) || '"' AS value FROM archive WHERE id % 4 <> 0
  UNION ALL SELECT id, tenant_id, id % 90 + 60, (id % 11)::VARCHAR FROM archive WHERE id % 4 <> 0),
attached AS (SELECT id AS document_id, tenant_id, id % 40 AS field_id, 'true' AS value FROM archive WHERE id % 3 <> 0),
merged AS (SELECT * FROM plain UNION ALL SELECT * FROM attached t WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.document_id = t.document_id AND p.field_id = t.field_id)),
made AS (SELECT min(id) AS id FROM archive GROUP BY tenant_id, id % 20)
SELECT document_id, field_id::VARCHAR AS field, value FROM merged m
WHERE EXISTS (SELECT 1 FROM custom_fields f WHERE f.id = m.field_id AND f.tenant_id = m.tenant_id)
UNION ALL SELECT id, 'new', '"n' || (id % 5) || '"' FROM made""",
)(
    lambda a: _upload_parts(a)["values"].select(
        "document_id",
        F.when(F.col("field_id").between(0, 149), F.col("field_id").cast("string")).otherwise("new").alias("field"),
        "value",
    )
)
query(
    "k10_upload_time_new_fields",
    "archive",
    """SELECT DISTINCT tenant_id, 'Extra ' || (id % 20) AS name, 'text' AS field_type FROM archive""",
)(lambda a: _upload_parts(a)["new_fields"].drop("field_id"))

query(
    "k11_retry_failed",
    "archive",
    f"SELECT id, CASE WHEN status = 'failed' AND id IN {_IDS} THEN 'queued' ELSE status END AS status FROM archive",
)(lambda a: mt.split_changed(mt.retry_failed(a.table("archive"), _ids(a)))[0].select("id", "status"))

query(
    "k11_reprocess",
    "archive document_types templates",
    """, req AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 25 END AS ty, CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 60 END AS tp FROM customer),
r AS (SELECT req.*, coalesce(x.document_type_id, ty) AS tid FROM req LEFT JOIN templates x ON x.id = tp)
SELECT a.id, CASE WHEN r.id IS NOT NULL THEN 'queued' ELSE status END AS status, coalesce(y.name, document_type) AS document_type,
  CASE WHEN y.id IS NOT NULL THEN y.id ELSE document_type_id END AS document_type_id, coalesce(tp, template_id) AS template_id,
  CASE WHEN r.id IS NULL THEN page_count END AS page_count, extracted_data IS NULL OR r.id IS NOT NULL AS no_data
FROM archive a LEFT JOIN r ON r.id = a.id LEFT JOIN document_types y ON y.id = r.tid""",
)(
    lambda a: mt.split_changed(
        mt.reprocess(
            a.table("archive"),
            a.parquet("customer").select(
                F.col("c_custkey").alias("id"),
                F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 25).alias("new_type_id"),
                F.when(F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 60).alias("new_template_id"),
            ),
            a.table("document_types"),
            a.table("templates"),
        )
    )[0].select(
        "id", "status", "document_type", "document_type_id", "template_id", "page_count", F.col("extracted_data").isNull().alias("no_data")
    )
)

query(
    "k13_cascade_delete",
    "document_tags tags",
    "SELECT document_id, tag_id FROM document_tags WHERE tag_id NOT IN (SELECT id FROM tags WHERE is_inbox_tag)",
)(lambda a: mt.cascade_delete(a.table("document_tags"), a.table("tags").filter("is_inbox_tag"), "tag_id"))

query(
    "k13_cascade_null",
    "archive correspondents",
    """SELECT id, CASE WHEN correspondent_id IN (SELECT id FROM correspondents WHERE email IS NULL) THEN NULL ELSE correspondent_id END AS correspondent_id FROM archive""",
)(
    lambda a: mt.cascade_null(
        a.table("archive").select("id", "correspondent_id"), a.table("correspondents").filter("email IS NULL"), "correspondent_id"
    )
)

# What goes with documents whose time in the trash is over, table by table.
_GOES = f"{_EXPIRED}, gone AS (SELECT id FROM purged)"
_CASCADES = {
    "document_tags": "SELECT document_id, tag_id FROM document_tags WHERE document_id NOT IN (SELECT id FROM gone)",
    "field_values": "SELECT document_id, field_id, value FROM field_values WHERE document_id NOT IN (SELECT id FROM gone)",
    "extractions": "SELECT id, document_id FROM extractions WHERE document_id NOT IN (SELECT id FROM gone)",
    "shares": "SELECT id, document_id FROM shares WHERE document_id NOT IN (SELECT id FROM gone)",
    "activity": "SELECT id, CASE WHEN document_id NOT IN (SELECT id FROM gone) THEN document_id END AS document_id FROM activity",
    "ai_usage": "SELECT id, CASE WHEN document_id NOT IN (SELECT id FROM gone) THEN document_id END AS document_id FROM ai_usage",
}


def _purged_tables(a: Archive):
    return mt.purge_dependents({"documents": a.table("archive"), **{t: a.table(t) for t in _CASCADES}}, _purge(a)["purged"])


for _name, _sql in _CASCADES.items():
    query(f"k13_purge_{_name}", f"archive tenants {_name}", f"{_GOES} {_sql}")(
        lambda a, t=_name, c=_sql: _purged_tables(a)[t].select(
            *(["document_id", "tag_id"] if t == "document_tags" else ["document_id", "field_id", "value"] if t == "field_values" else ["id", "document_id"])
        )
    )

query(
    "k13_purge_postings",
    "archive tenants",
    f"""{_GOES} SELECT id, lexeme, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(concat_ws(' ', nullif(title, ''), nullif(original_filename, ''))), '[\\p{{L}}\\p{{N}}]+')) AS lexeme
  FROM archive WHERE id NOT IN (SELECT id FROM gone)) WHERE lexeme IN ('customer', 'pdf') GROUP BY ALL""",
)(lambda a: _purged_postings(a))


def _purged_postings(a: Archive):
    docs = a.table("archive").select("tenant_id", "id", "title", "original_filename", F.lit(None).cast("string").alias("text"))
    index = SearchIndex.build(Catalog(a.spark, shared_folder(a.spark, "index")), docs, english=False, spans=2, slots=1)
    index.apply(1, docs.limit(0), _purge(a)["purged"].select("tenant_id", "id"))
    index.merge(1)
    return index.current_words(F.col("lexeme").isin("customer", "pdf")).select("id", "lexeme", F.size("positions").cast("bigint").alias("n"))


# Two steps: types take their templates with them, and documents lose both.
query(
    "k13_cascade_types",
    "archive document_types templates",
    """, gone AS (SELECT id FROM document_types WHERE extraction_method IS NULL), lost AS (SELECT id FROM templates WHERE document_type_id IN (SELECT id FROM gone))
SELECT id, CASE WHEN document_type_id NOT IN (SELECT id FROM gone) THEN document_type_id END AS document_type_id,
  CASE WHEN template_id NOT IN (SELECT id FROM lost) THEN template_id END AS template_id FROM archive""",
)(
    lambda a: mt.cascade(
        {"documents": a.table("archive"), "templates": a.table("templates"), "document_types": a.table("document_types")},
        "document_types",
        a.table("document_types").where("extraction_method IS NULL"),
    )["documents"].select("id", "document_type_id", "template_id")
)

# Two batches, the first written twice; the second reports some events of the first again.
query(
    "a12_audit_log",
    "archive",
    f"""SELECT tenant_id, 'trash' AS type, id AS document_id FROM archive WHERE deleted_at IS NULL AND id IN {_IDS}
UNION ALL SELECT tenant_id, 'edit', id FROM archive""",
)(lambda a: _logged(a))


def _logged(a: Archive):
    trash = mt.activity(mt.split_changed(mt.bulk_trash(a.table("archive"), _ids(a), AS_OF))[1], "trash", AS_OF, 7, "Ana")
    edits = mt.activity(a.table("archive"), "edit", AS_OF, 7, "Ana")
    path = shared_folder(a.spark, "audit")
    for events, batch in ((trash, "1"), (trash, "1"), (edits.unionByName(trash), "2")):
        mt.append_activity(events, path, batch)
    return AuditLog(a.spark, path).read(trash).select("tenant_id", "type", "document_id")


query(
    "k14_unique_key_check",
    "templates",
    "SELECT tenant_id, lower(name) AS name, count(*) AS n FROM templates GROUP BY 1, 2 HAVING count(*) > 1",
)(lambda a: mt.unique_key_check(a.table("templates"), "tenant_id", "name", fold=True))

query(
    "k14_unique_attachments",
    "type_fields",
    "SELECT document_type, field_id, count(*) AS n FROM type_fields GROUP BY 1, 2 HAVING count(*) > 1",
)(lambda a: mt.unique_key_check(a.table("type_fields"), "document_type", "field_id"))
