"""Archive tables and registered queries keep every row of the given tables."""

import hashlib
import os

import pytest

import __spark_entry__ as entry_module
from ledgerloom.sources.archive import Archive

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES = entry_module.queries()


def test_every_order_is_a_mail(spark):
    archive = Archive(spark, FOLDER)
    orders = archive.parquet("orders").count()
    assert archive.table("mails").count() == orders
    assert QUERIES["h03_parse_sender"](spark, FOLDER).count() == orders


def test_every_customer_is_a_user_and_every_part_a_field(spark):
    archive = Archive(spark, FOLDER)
    assert archive.table("users").count() == archive.parquet("customer").count()
    assert archive.table("custom_fields").count() == archive.parquet("part").count()
    # Both still leave rows without a partner.
    owned = archive.table("archive").join(archive.table("users").selectExpr("id AS uploaded_by"), "uploaded_by", "left_semi")
    assert 0 < owned.count() < archive.table("archive").count()
    known = archive.table("field_values").join(archive.table("custom_fields").selectExpr("id AS field_id"), "field_id", "left_semi")
    assert 0 < known.count() < archive.table("field_values").count()


def test_every_rendered_text_has_its_golden_answer(spark):
    rows = QUERIES["c18_evaluate_against_golden"](spark, FOLDER).where("document >= 0").collect()
    golden = {r.document for r in rows if r.expected is not None}
    assert golden == {r.id for r in Archive(spark, FOLDER).table("rendered").select("id").collect()}


def test_every_document_is_accepted_or_rejected(spark):
    rows = QUERIES["a01_ingest_files"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in Archive(spark, FOLDER).parquet("documents").select("doc_id", "text").collect()}
    assert sorted(int(r.filename.split(".")[0]) for r in rows) == sorted(texts)
    for r in rows:
        key = int(r.filename.split(".")[0])
        # Broken archives and bytes of no kind are refused.
        assert (r.reject_reason == "unsupported_type") == (key % 12 in (5, 8)) == (r.checksum is None)
        if key % 12 == 10:
            assert r.mime_type == "text/csv" and r.checksum == hashlib.sha256(texts[key].encode()).hexdigest()


def test_fusion_ranks_whole_lists(spark):
    got = QUERIES["k05_rrf"](spark, FOLDER).collect()
    assert len(got) >= Archive(spark, FOLDER).parquet("embeddings").count()
