"""No default cuts rows or text; answers that used to be misread."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import extract, joins, model_output, rules
from ledgerloom.sources import files


def test_text_and_dates_are_read_to_the_end(spark):
    df = spark.createDataFrame([("x " * 4000 + "needle 2001-03-04",)], "text string")
    row = df.select(
        rules.rule_text(F.lit("t"), F.col("text")).contains("needle").alias("hit"),
        extract.document_date(F.col("text"), datetime.date(2002, 1, 1)).alias("date"),
        F.size(extract.chunks(F.repeat(F.lit("line of text\n"), 2000))).alias("chunks"),
    ).first()
    assert row["hit"] and row["date"] == datetime.date(2001, 3, 4) and row["chunks"] > 6


def test_case_folding(spark):
    assert spark.range(1).select((rules.fold(F.lit("STRASSE")) == rules.fold(F.lit("Straße"))).alias("same")).first()["same"]


@pytest.mark.parametrize(
    "text,safe",
    [("<a/>", True), ("<!--" + "x" * 9000 + "--><!DOCTYPE a><a/>", False), ("<!-- <b --><!ENTITY e><a/>", False), ("<a><![CDATA[<!DOCTYPE]]></a>", True)],
)
def test_late_document_types_are_unsafe(spark, text, safe):
    assert (spark.range(1).select(files._safe_xml(F.lit(text)).alias("t")).first()["t"] is not None) == safe


def test_only_whole_answers_are_parsed(spark):
    raw = ['{"a": 1}', 'Answer: {"a": 1} done', 'Answer: {"a":1} and {"b":2}']
    df = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = {r["id"]: r["parsed"] for r in model_output.parse_model_output(df).collect()}
    assert got[0] and got[1] and '"b"' not in (got[2] or "") and not (got[2] or "").startswith('{"a"')


def test_string_ids_are_numbered_in_order(spark):
    rows = [(f"{i:03x}f", "a.pdf") for i in range(0, 4000, 7)]
    got = {r["id"]: r["unique_name"] for r in joins.disambiguate_filenames(spark.createDataFrame(rows, "id string, original_filename string")).collect()}
    want = {i: "a.pdf" if n == 0 else f"a ({n}).pdf" for n, (i, _) in enumerate(sorted(rows))}
    assert got == want


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        session.shared_folder(Spark(), "x")
