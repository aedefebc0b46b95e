"""Catalogs, attached fields and uploads keep to their tenant."""

from ledgerloom.operators import joins as jn
from ledgerloom.operators import maintain as mt


def test_type_by_name_takes_system_and_own_rows_only(spark):
    docs = spark.createDataFrame([("a", "invoice"), ("b", "invoice"), ("b", "memo"), ("c", "memo"), (None, "invoice"), ("a", None)], "tenant_id string, document_type string")
    types = spark.createDataFrame([(5, None, "invoice"), (7, "a", "invoice"), (2, "b", "invoice"), (3, "b", "memo"), (4, "b", "memo")], "id int, tenant_id string, name string")
    got = {(r.tenant_id, r.document_type): r.named_type_id for r in jn.type_by_name(docs, types).collect()}
    assert got == {("a", "invoice"): 5, ("b", "invoice"): 2, ("b", "memo"): 3, (None, "invoice"): 5}


def test_observed_types_are_held_against_the_own_catalog(spark):
    docs = spark.createDataFrame([("a", "memo"), ("b", "memo"), ("a", "invoice"), ("a", "memo")], "tenant_id string, document_type string")
    types = spark.createDataFrame([(1, None, "invoice"), (2, "b", "memo")], "id int, tenant_id string, name string")
    assert [tuple(r) for r in jn.types_outside_catalog(docs, types).select("tenant_id", "name").collect()] == [("a", "memo")]


def test_fields_of_other_tenants_change_nothing(spark):
    fields = spark.createDataFrame([(1, "a", "Cost"), (2, "b", "Site")], "id long, tenant_id string, name string")
    links = spark.createDataFrame([(10, "a", "memo", 1, True, 0), (11, "a", "memo", 2, True, 1), (12, "b", "memo", 2, False, 0)],
                                  "id int, tenant_id string, document_type string, field_id long, required boolean, position int")
    types = spark.createDataFrame([("a", "memo"), ("b", "memo"), ("b", "letter")], "tenant_id string, document_type string")
    lists = jn.predefined_fields(types, links, fields.selectExpr("*", "'text' AS field_type"))
    got = {(r.tenant_id, r.document_type): [f.id for f in r.fields] for r in lists.collect()}
    assert got == {("a", "memo"): [10], ("b", "memo"): [12], ("b", "letter"): []}

    upload = [(1, "a", "memo", '{"1":5,"2":6}', '[{"fieldId":2,"value":7},{"fieldId":1,"value":8}]', None), (2, "b", "memo", '{"1":9}', None, "no json")]
    docs = spark.createDataFrame(upload, "id long, tenant_id string, document_type string, field_values string, attach_fields string, new_fields string")
    out = mt.upload_time_fields(docs, fields, links.filter("id = 12"))
    assert [tuple(r) for r in out["values"].collect()] == [(1, 1, "5")]
    assert [tuple(r) for r in out["new_type_fields"].collect()] == [("a", "memo", 1)]
