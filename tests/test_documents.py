"""Filters, normalisation, spreadsheets, trash, budgets and duplicates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import jsonvalues as jv
from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import filters as flt
from ledgerloom.operators import joins as jn
from ledgerloom.operators import maintain as mt
from ledgerloom.operators import normalize as nz
from ledgerloom.operators import spreadsheet as sh
from ledgerloom.sources import exports as xp

FIELDS = [(1, "Cost Center", "text"), (2, "Priority", "select"), (3, "Renewal", "boolean"), (4, "Amount", "number"), (5, "End", "date")]
VALUES = [
    ("i1", 1, '"Marketing Team"'), ("i1", 2, '"Travel"'), ("i2", 1, '"Sales Team"'), ("i2", 2, '"International Travel"'),
    ("c1", 3, "true"), ("c1", 4, "5000"), ("c1", 5, '"2026-12-31"'), ("c2", 3, "false"), ("c2", 4, "1000"), ("c2", 5, '"2025-06-01"'),
]


@pytest.mark.parametrize(
    "field, conditions, expected",
    [
        (2, {"value": "Travel"}, {"i1"}),
        (1, {"value": "team"}, {"i1", "i2"}),
        (3, {"value": "true"}, {"c1"}),
        (4, {"low": 2000}, {"c1"}),
        (4, {"low": 500, "high": 2000}, {"c2"}),
        (5, {"last": "2025-12-31"}, {"c2"}),
        (3, {"low": 1}, {"i1", "i2", "c1", "c2"}),
        (1, {}, {"i1", "i2", "c1", "c2"}),
        (99, {"value": "x"}, set()),
    ],
)
def test_custom_field_filter(spark, field, conditions, expected):
    docs = spark.createDataFrame([("i1",), ("i2",), ("c1",), ("c2",)], "id string")
    fields = spark.createDataFrame(FIELDS, "id int, name string, field_type string")
    values = spark.createDataFrame(VALUES, "document_id string, field_id int, value string")
    out = flt.by_custom_field(docs, values, fields, field, **conditions)
    assert {r.id for r in out.collect()} == expected


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    assert flt.tenant_scope(df, None).count() == 0
    assert flt.tenant_scope(df, "").count() == 0
    assert flt.tenant_scope(df, "a").count() == 1


def test_upload_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    rows = [(1, dt.datetime(2024, 1, 1, 23, 59), None), (2, dt.datetime(2024, 1, 3), None)]
    spark.createDataFrame(rows, "id int, uploaded_at timestamp_ntz, deleted_at timestamp_ntz").write.parquet(path)
    out = flt.by_uploaded_date(spark.read.parquet(path), "2024-01-01", "2024-01-02")
    assert [r.id for r in out.collect()] == [1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(uploaded_at" in plan and "LessThan(uploaded_at" in plan


def test_truncation_flag(spark):
    df = spark.range(6).select("id", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz").alias("uploaded_at"))
    order = flt.sort_columns(None)
    assert {r.truncated for r in flt.limit_with_truncation_flag(df, order, 6).collect()} == {False}
    over = flt.limit_with_truncation_flag(df, order, 5).collect()
    assert len(over) == 5 and {r.truncated for r in over} == {True}


TYPED = [
    ('{"vendor":"A","invoiceNumber":"N1","totalAmount":10.5,"currency":"USD"}', ("A", "N1", 10.5, "USD")),
    ('{"vendor":"A","invoice_number":"N2","total_amount":5,"grand_total":9}', ("A", "N2", 5.0, None)),
    ('{"vendor":" ","invoiceNumber":7,"grand_total":"1,234.50","currency":""}', (None, None, 1234.5, None)),
    ('{"vendor":["x"],"total_amount":0,"grand_total":"-3"}', (None, None, -3.0, None)),
    ('{"totalAmount":"$ 5"}', (None, None, None, None)),
    ('{"totalAmount":true}', (None, None, 1.0, None)),
    ('{"totalAmount":"1d"}', (None, None, None, None)),
    ('{"vendor_details":{"company_name":"B"}}', (None, None, None, None)),
    ("not json", (None, None, None, None)),
    (None, (None, None, None, None)),
]


def test_typed_fields(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TYPED)], "id int, extracted_data string")
    got = {r.id: tuple(r.typed) for r in nz.typed_fields(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TYPED)}


def test_parse_amount(spark):
    cases = {'"$ 1,234.56"': 1234.56, '"RM500"': 500.0, "100": 100.0, "null": None, '"not_a_number"': None, '"1.200,50"': 1.2005, "[1]": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", nz.parse_amount(F.parse_json("t")).alias("a")).collect()
    assert {r.t: r.a for r in got} == cases


def test_alias_keys(spark):
    data = '{"vendor_name":"V","invoice_no":"1","grand_total":5,"line_items":[],"po_ref":"p","supplier":"S"}'
    df = spark.createDataFrame([(data,)], "extracted_data string")
    fields = nz.alias_keys(df)
    keys = fields.select(F.map_keys("fields")).first()[0]
    assert set(keys) == {"vendor", "invoiceNumber", "totalAmount", "lineItems", "po_ref"}
    # The shorter raw key comes first.
    assert fields.select(jv.text_of(jv.key(F.col("fields"), "vendor"))).first()[0] == "S"


def test_expanded_rows(spark):
    rows = [
        (1, '{"vendor":"V","items":[{"description":"A","qty":0,"unitPrice":"RM 2","sub_items":[{"name":"s","quantity":3},4]},7]}'),
        (2, '{"line_items":"none"}'),
        (3, '{"line_items":[1,2]}'),
        (4, '{"line_items":[{}]}'),
    ]
    df = spark.createDataFrame(rows, "id int, extracted_data string").withColumns(
        {"original_filename": F.lit("f"), "document_type": F.lit("t"), "status": F.lit("s"),
         "uploaded_at": F.lit(dt.datetime(2024, 1, 1)), "document_date": F.lit(None).cast("date")}
    )
    got = [(r.id, r.depth, r.itemDescription, r.itemQuantity, r.itemUnitPrice) for r in sh.expanded_rows(df, ["vendor"]).orderBy("id", "item_no", "depth").collect()]
    assert got == [(1, 0, "A", "0", 2.0), (1, 1, "s", "3", None), (2, 0, None, None, None), (4, 0, None, None, None)]
    counts = {r.id: r.itemCount for r in sh.summary_rows(df, []).collect()}
    assert counts == {1: 2, 2: None, 3: 2, 4: 1}


def test_shallow_merge(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"x":1}}', '{"b":null,"c":2}'), (None, '{"a":1}')], "d string, p string")
    got = [r[0] for r in df.select(nz.shallow_merge(F.col("d"), F.col("p"))).collect()]
    assert got == ['{"a":1,"b":null,"c":2}', '{"a":1}']


def test_disambiguate_filenames(spark):
    names = ["a.tar.gz", "a.tar.gz", "b", "b", ".rc", ".rc", "c.", "c."]
    df = spark.createDataFrame(list(enumerate(names)), "id long, original_filename string")
    got = [r.unique_name for r in jn.disambiguate_filenames(df).orderBy("id").collect()]
    assert got == ["a.tar.gz", "a.tar (1).gz", "b", "b (1).b", ".rc", ".rc (1).rc", "c.", "c. (1)"]


def test_trash_retention(spark):
    now = dt.datetime(2026, 7, 1)
    ago = lambda days: now - dt.timedelta(days=days)
    tenants = spark.createDataFrame(
        [("T1", 10, None, 100), ("T2", None, None, 100), ("T3", 1, now - dt.timedelta(hours=23), 100)],
        "tenant_id string, trash_retention_days int, trash_last_purged_at timestamp_ntz, storage_used_bytes long",
    )
    docs = spark.createDataFrame(
        [(1, "T1", ago(11), 30), (2, "T1", ago(9), 5), (3, "T2", ago(31), 200), (4, "T2", ago(11), 5), (5, "T3", ago(99), 5), (6, "T1", None, 5), (7, "T1", ago(10), 1)],
        "id int, tenant_id string, deleted_at timestamp_ntz, size_bytes long",
    )
    out = mt.purge_expired(docs, tenants, now)
    assert sorted(r.id for r in out["purged"].collect()) == [1, 3]
    assert sorted(r.id for r in out["kept"].collect()) == [2, 4, 5, 6, 7]
    assert {r.tenant_id: r.storage_used_bytes for r in out["tenants"].collect()} == {"T1": 70, "T2": 0, "T3": 100}
    events = {r.tenant_id: r.meta for r in out["events"].collect()}
    assert events == {
        "T1": "Auto-purged 1 document(s) past the 10-day retention period",
        "T2": "Auto-purged 1 document(s) past the 30-day retention period",
    }
    again = mt.purge_expired(out["kept"], out["tenants"], now + dt.timedelta(hours=1))
    assert sorted(r.id for r in again["purged"].collect()) == [5]  # only the tenant that had been skipped


def test_running_budget_equals_brute_force(spark):
    import random

    rng = random.Random(7)
    calls = [(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(0, 9), dt.datetime(2024, rng.randint(1, 2), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))) for i in range(400)]
    caps = {"a": 300, "b": 0, "c": None}
    df = spark.createDataFrame(calls, "id int, tenant_id string, total_tokens long, created_at timestamp_ntz")
    tenants = spark.createDataFrame(list(caps.items()), "tenant_id string, llm_monthly_token_cap long")
    got = {r.id: r.admitted for r in agg.running_budget(df, tenants).collect()}
    used, want = {}, {}
    for i, tenant, tokens, at in sorted(calls, key=lambda c: (c[3], c[0])):
        cap = 2_000_000 if caps[tenant] is None else caps[tenant]
        spent = used.get((tenant, at.month), 0)
        want[i] = cap > 0 and spent < cap
        if want[i]:
            used[(tenant, at.month)] = spent + tokens
    assert got == want


def test_duplicates_and_dedup_on_a_hot_key(spark):
    rows = [(i, "t", "V" if i < 300 else f"V{i}", "1", dt.datetime(2024, 1, 1), None) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, tenant_id string, vendor string, invoice_no string, uploaded_at timestamp_ntz, deleted_at timestamp_ntz")
    got = {r.id: r.duplicate_of for r in jn.duplicate_invoices(df).collect()}
    assert got == {0: 1} | {i: 0 for i in range(1, 300)}
    files = spark.createDataFrame([(i, "t", "same" if i < 300 else str(i)) for i in range(400)], "idx int, tenant_id string, checksum string")
    known = spark.createDataFrame([("t", "399"), ("u", "398")], "tenant_id string, checksum string")
    fresh = sorted(r.idx for r in jn.ingest_dedup(files, known).collect())
    assert fresh == [0] + list(range(300, 399))


def test_export(spark, tmp_path):
    rows = [(1, "Invoice ABC.pdf", "Acme Corp", "INV-1", 100, "USD"), (2, "Receipt \"X\", 2", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, vendor string, invoice_no string, total_amount int, currency string").withColumns(
        {"original_filename": F.lit("f.pdf"), "document_type": F.lit("invoice"), "status": F.lit("completed"),
         "document_date": F.lit(None).cast("date"), "uploaded_at": F.lit(dt.datetime(2026, 1, 2, 3, 4, 5)).cast("timestamp_ntz")}
    )
    path = str(tmp_path / "csv")
    xp.write_csv(xp.export_rows(df, limit=None).coalesce(1), path)
    (part,) = [p for p in (tmp_path / "csv").iterdir() if p.name.startswith("part")]
    raw = part.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[0] == ",".join(xp.EXPORT_COLUMNS)
    assert lines[1] == "Invoice ABC.pdf,Acme Corp,INV-1,100.00,USD,invoice,completed,,2026-01-02T03:04:05+00:00"
    assert lines[2] == '"Receipt ""X"", 2",,,,,invoice,completed,,2026-01-02T03:04:05+00:00'
    assert not xp.export_rows(df, limit=2).filter("truncated").count()
    assert xp.export_rows(df, limit=1).filter("truncated").count() == 1


def test_unique_keys_and_upserts(spark):
    df = spark.createDataFrame([("t", "A"), ("t", "a"), ("u", "A"), ("t", None), ("t", None)], "tenant_id string, name string")
    assert mt.unique_key_check(df, "tenant_id", "name").count() == 0
    assert mt.unique_key_check(df, "tenant_id", "name", fold=True).collect()[0].n == 2
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "document_id int, field_id int, value string")
    new = spark.createDataFrame([(1, 1, "c", 1), (1, 1, "d", 2), (2, 1, "e", 1)], "document_id int, field_id int, value string, seq int")
    gone = spark.createDataFrame([(1, 2)], "document_id int, field_id int")
    got = sorted(tuple(r) for r in mt.upsert_field_values(old, new, gone).collect())
    assert got == [(1, 1, "d"), (2, 1, "e")]
