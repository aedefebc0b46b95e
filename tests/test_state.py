"""Running sums in order, the checksum store, the intake job, the audit log and cascades."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import aggregates as agg
from ledgerloom.operators import joins as jn
from ledgerloom.operators import maintain as mt
from ledgerloom.operators import model_output as mo
from ledgerloom.operators import ordered
from ledgerloom.operators.audit import AuditLog
from ledgerloom.operators.search_index import SearchIndex
from ledgerloom.session import materialise, shared_folder
from ledgerloom.sources.catalog import Catalog
from ledgerloom.sources.checksums import ChecksumStore
from ledgerloom.streaming import intake as stream
from ledgerloom.streaming.intake import batch_writer

AT = dt.datetime(2024, 1, 1)


def exchanges(df):
    """Lines of the plan that shuffle or send rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def shuffled(df):
    """Columns of every shuffle of the plan."""
    execution = df._jdf.queryExecution()
    plan = execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\(\d+\) Exchange\nInput[^:]*: \[(.*?)\]\n", plan)


# -- running sums -------------------------------------------------------------------


def test_all_calls_of_a_tenant_in_one_second(spark):
    rng = random.Random(1)
    calls = [(i, "hot", rng.randint(0, 9), AT) for i in range(2_000)] + [(5_000 + i, "cold", 1, AT) for i in range(10)] + [(9_000, None, 5, AT), (9_001, None, 5, AT)]
    df = spark.createDataFrame(calls, "id int, tenant_id string, total_tokens long, created_at timestamp_ntz").repartition(4)
    tenants = spark.createDataFrame([("hot", 1_000), ("cold", 4)], "tenant_id string, llm_monthly_token_cap long")
    got = {r["id"]: (r["used_before"], r["admitted"]) for r in agg.running_budget(df, tenants).collect()}
    used, want = {}, {}
    for i, tenant, tokens, _ in sorted(calls):
        cap = {"hot": 1_000, "cold": 4, None: 2_000_000}[tenant]
        spent = used.get(tenant, 0)
        want[i] = (spent, spent < cap)
        used[tenant] = spent + tokens
    assert got == want


def test_a_hot_key_is_dealt_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(4_000).select(F.lit("k").alias("k"), F.lit(0).alias("at"), "id")
        dealt = ordered.dealt_by_range(rows, ["k"], ["at", "id"]).groupBy("_range").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) < 2_000


def test_names_with_one_prefix_are_numbered(spark):
    rows = [(f"abc{i:04d}", "same.pdf") for i in range(300)] + [("zzz", "other")]
    got = {r["id"]: r["unique_name"] for r in jn.disambiguate_filenames(spark.createDataFrame(rows, "id string, original_filename string")).collect()}
    want = {f"abc{i:04d}": "same.pdf" if i == 0 else f"same ({i}).pdf" for i in range(300)} | {"zzz": "other"}
    assert got == want


# -- duplicates -----------------------------------------------------------------------


def test_no_text_in_the_shuffle_of_the_duplicate_check(spark):
    files = spark.createDataFrame([(i, "t", str(i % 5), "long text") for i in range(20)] + [(30, None, "1", "x"), (31, None, "1", "x")], "idx int, tenant_id string, checksum string, text string")
    known = spark.createDataFrame([("t", "1"), (None, "9")], "tenant_id string, checksum string")
    fresh = jn.ingest_dedup(files, known)
    assert sorted(r["idx"] for r in fresh.collect()) == [0, 2, 3, 4, 30]
    moved = [line for line in exchanges(fresh) if "Broadcast" not in line]
    assert moved and not any("text" in line for line in moved)
    assert sorted(r["idx"] for r in jn.first_in_batch(files).collect()) == [0, 1, 2, 3, 4, 30]


def test_a_batch_reads_only_its_prefixes(spark):
    store = ChecksumStore(spark, shared_folder(spark, "checksums"))
    store.create()
    first = spark.createDataFrame([("t", "aa1", 1), ("t", "bb2", 2), ("u", "aa1", 3)], "tenant_id string, checksum string, id long")
    store.add(first, 0)
    store.add(first, 0)  # again
    store.create()  # keeps what is there
    store.add(spark.createDataFrame([("t", "aa9", 4), ("t", None, 5)], "tenant_id string, checksum string, id long"), 1)
    mine = spark.createDataFrame([("t", "aaf")], "tenant_id string, checksum string")
    known = store.known(mine, 2)
    assert sorted(map(tuple, known.collect())) == [("t", "aa1"), ("t", "aa9"), ("u", "aa1")]
    assert sorted(map(tuple, store.known(mine, 1).collect())) == [("t", "aa1"), ("u", "aa1")]
    assert store.known(mine.limit(0), 2).collect() == []
    opened = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in opened and "prefix" in opened.split("PartitionFilters")[1].split("]")[0]


# -- intake ----------------------------------------------------------------------------

SCHEMA = "id long, tenant_id string, text string, mime_type string, original_filename string, title string, uploaded_at timestamp_ntz"
GOOD = "INVOICE\nAcme Ltd\nInvoice No: A-1\nDate: 2024-01-01\nTotal: 5.00"


def arrivals(*rows):
    return [(i, tenant, text, mime, f"{i}.pdf", f"title {i}", AT) for i, tenant, text, mime in rows]


def test_the_job_of_a_batch(spark):
    path = shared_folder(spark, "job")
    empty = spark.createDataFrame([], "tenant_id string, id long, title string, original_filename string, text string, uploaded_at timestamp_ntz, deleted_at timestamp_ntz")
    index = SearchIndex.build(Catalog(spark, shared_folder(spark, "job-index")), empty, spans=1, slots=1)
    allowed = spark.createDataFrame([("t", True), ("u", False)], "tenant_id string, allowed boolean")
    write = batch_writer(path, allowed, index)
    one = spark.createDataFrame(arrivals((1, "t", GOOD, "application/pdf"), (2, "t", "receipt", "image/png"), (3, "t", "receipt", "image/png"), (4, "u", "receipt", "image/png"), (5, "t", "receipt or bill", "application/xml"), (6, "t", "memo", "text/plain"), (6, "t", "memo", "text/plain"), (7, None, "memo", "text/plain")), SCHEMA)
    two = spark.createDataFrame(arrivals((8, "t", GOOD, "application/pdf"), (9, "u", GOOD, "application/pdf"), (10, "t", "harbour memo", "text/plain")), SCHEMA)

    def state():
        docs = {r["id"]: (r["status"], r["extraction_status"], r["extraction_method"], r["gate_passed"]) for r in spark.read.parquet(path).collect()}
        queue = sorted((r["id"], r["mode"]) for r in spark.read.parquet(f"{path}.state/queue").collect())
        log = AuditLog(spark, f"{path}.state/audit").read(mt.activity(spark.read.parquet(path).withColumn("original_filename", F.lit("")), "upload", AT))
        events = sorted((r["document_id"], r["type"], r["meta"]) for r in log.collect())
        found = sorted(r["id"] for r in index.current_words(F.col("lexeme").isin("memo", "harbour")).select("id").distinct().collect())
        stored = ChecksumStore(spark, f"{path}.state/checksums").spark.read.parquet(f"{path}.state/checksums").count()
        return docs, queue, events, found, stored

    write(one, 0)
    docs, queue, events, _, stored = state()
    assert docs == {
        1: ("completed", "accepted", "deterministic", True),
        2: ("needs_review", "low_confidence", "vlm", False),
        4: ("needs_review", "skipped_budget", "vlm", False),
        5: ("needs_review", "low_confidence", "deterministic", False),
        6: ("completed", "none", None, None),
        7: ("completed", "none", None, None),
    }
    assert queue == [(2, "vision")]
    assert [e[:2] for e in events] == sorted((i, k) for i in docs for k in ("upload", "processing_complete"))
    assert stored == len(docs)
    write(two, 1)
    whole = state()
    assert set(whole[0]) == {1, 2, 4, 5, 6, 7, 9, 10}
    # A document without tenant is stored but not indexed.
    assert whole[3] == [6, 10]
    # Both batches again, as after a lost driver: the same tables.
    write(one, 0)
    write(two, 1)
    assert state() == whole


def test_texts_of_a_batch_are_not_shuffled_nor_kept_twice(spark, monkeypatch):
    # a join of all staged rows by their place, and one by tenant, shuffled the texts; copies of them stayed.
    monkeypatch.setattr(stream, "BLOCK", 7)
    rng = random.Random(4)
    words = [rng.randbytes(1500).hex() for _ in range(40)]
    rows = [(i % 90, ("t", "u", None)[i % 3], None if i % 11 == 0 else f"memo {words[i % 40]}") for i in range(400)]
    batch = spark.createDataFrame(rows, "id long, tenant_id string, text string").repartition(3)
    folder = shared_folder(spark, "batch")
    staged = stream._staged(batch, f"{folder}/staged")
    known = spark.createDataFrame([("t", f"memo {words[1]}"), ("t", None)], "tenant_id string, text string").select("tenant_id", F.sha2("text", 256).alias("checksum"))
    allowed = spark.createDataFrame([("t", True), (None, True)], "tenant_id string, allowed boolean")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
        fresh = stream._fresh(staged, known, f"{folder}/bits")
        want = jn.ingest_dedup(staged, known)
        assert any("text" in columns for columns in shuffled(want))
        assert not any("text" in columns for columns in shuffled(stream.process_documents(fresh, materialise(spark, allowed, "allowed"))))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(staged.inputFiles()) > 50
    one, two = (sorted((tuple(r) for r in df.select("id", "tenant_id", "text", "checksum", "idx").collect()), key=str) for df in (want, fresh))
    assert one == two and 90 < len(one) < 400
    path = shared_folder(spark, "lean")
    batch_writer(path)(batch, 0)
    state = set(os.listdir(f"{path}.state/staged"))
    assert not [x for x in state if x.startswith("batch_id")]
    assert "text" not in spark.read.parquet(f"{path}.state/processed").columns


# -- audit log ---------------------------------------------------------------------------


def test_each_event_once(spark):
    docs = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, None, "c")], "id long, tenant_id string, original_filename string")
    events = mt.activity(docs, "edit", AT, 1, "Ana")
    path = shared_folder(spark, "audit")
    mt.append_activity(events, path, "1")
    mt.append_activity(events, path, "1")
    mt.append_activity(events.unionByName(mt.activity(docs, "edit", AT, 2, "Ben")), path, "2")
    got = AuditLog(spark, path).read(events)
    assert sorted((r["document_id"], r["user_name"]) for r in got.collect()) == sorted((i, n) for i in (1, 2, 3) for n in ("Ana", "Ben"))


def test_events_are_told_apart_by_bytes(spark):
    # the digests were shuffled as digits.
    docs = spark.createDataFrame([(1, "t", "a"), (1, "t", "a"), (2, None, "b")], "id long, tenant_id string, original_filename string")
    path = shared_folder(spark, "audit")
    mt.append_activity(mt.activity(docs, "edit", AT, 1, "Ana"), path, "1")
    got = AuditLog(spark, path).read(mt.activity(docs, "edit", AT, 1, "Ana"))
    assert sorted(r["document_id"] for r in got.collect()) == [1, 2] and "event_id" in got.columns
    assert shuffled(got.select("type")) and not any("event_id" in columns for columns in shuffled(got.select("type")))


# -- cascades -----------------------------------------------------------------------------


def test_cascade_follows_deleted_dependents(spark):
    make = spark.createDataFrame
    tables = {
        "documents": make([(1, 10, 5, 100), (2, 11, 6, 100), (3, 11, None, 101)], "id long, document_type_id long, template_id long, correspondent_id long"),
        "document_types": make([(10,), (11,)], "id long"),
        "templates": make([(5, 10, 1), (6, 11, 2), (7, 11, 1)], "id long, document_type_id long, sample_document_id long"),
        "extractions": make([(50, 1, 6), (51, 2, 5)], "id long, document_id long, template_id long"),
        "document_tags": make([(1, 9), (2, 9)], "document_id long, tag_id long"),
    }

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    out = mt.cascade(tables, "document_types", make([(11,)], "id long"))
    assert rows(out["templates"].select("id")) == [(5,)]
    assert rows(out["documents"].select("id", "document_type_id", "template_id")) == [(1, 10, 5), (2, None, None), (3, None, None)]
    assert rows(out["extractions"].select("id", "template_id")) == [(50, None), (51, 5)]
    assert rows(out["document_tags"]) == rows(tables["document_tags"])
    gone = mt.purge_dependents(tables, make([(1,), (1,)], "id long"))
    assert rows(gone["documents"].select("id")) == [(2,), (3,)]
    assert rows(gone["document_tags"]) == [(2, 9)]
    assert rows(gone["extractions"].select("id")) == [(51,)]
    assert rows(gone["templates"].select("id", "sample_document_id")) == [(5, None), (6, 2), (7, None)]


@pytest.mark.parametrize("calls", [("header", "items"), ("items",)])
def test_header_items_never_reach_the_merged_list(spark, calls):
    answers = spark.createDataFrame(
        [(1, 0, '{"vendor":"Own Ltd","line_items":[{"d":"one"}],"total":3}'), (1, 1, '{"line_items":[{"d":"two"}],"total":4}')],
        "document_id long, chunk_no int, raw string",
    )
    parsed = mo.parse_model_output(answers).select("document_id", "chunk_no", "fields", "model_type", "confidence")
    parts = parsed.withColumn("call", F.explode(F.when(F.col("chunk_no") == 0, F.array(*map(F.lit, calls))).otherwise(F.array(F.lit("items")))))
    got = {r["key"]: r["value"] for r in mo.merge_chunk_fields(mo.two_phase_parts(parts)).collect()}
    assert got == {"vendor": '"Own Ltd"', "line_items": '[{"d":"one"},{"d":"two"}]', "total": "4"}
