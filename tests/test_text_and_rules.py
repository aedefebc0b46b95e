"""Search, match rules, senders, model answers, XML, file intake and streams."""

import datetime as dt
import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.pyjson import close_truncated, order_keys_by_schema
from ledgerloom.functions.stem import stem
from ledgerloom.operators import model_output as mo
from ledgerloom.operators import rules as ru
from ledgerloom.operators import search as se
from ledgerloom.session import shared_folder
from ledgerloom.sources import files as fl
from ledgerloom.streaming.intake import batch_writer, stream_ingest

# -- search --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("A", "Harbour Ledger Overview.pdf", "Harbour Ledger Overview.pdf", "report", "Dredging of the northern basin has ended; an interim timetable follows."),
        ("B", "Ferry Operator Charter.pdf", "Ferry Operator Charter.pdf", "contract", "The crew timetable hangs beside the mooring timetable on the pier."),
        ("C", "Lantern Survey 2024.pdf", "Revised Toll Forecast.pdf", "report", None),
        ("D", "Crate Inventory.pdf", "Crate Inventory.pdf", "report", "Every gadget <svg onload='steal()'> is in stock & counted."),
        ("X", "Discarded timetable.pdf", "Discarded timetable.pdf", "report", "timetable timetable timetable"),
    ]
    docs = spark.createDataFrame(
        [(*r, t, t if r[0] == "X" else None) for r in rows],
        "id string, original_filename string, title string, document_type string, text string, uploaded_at timestamp_ntz, deleted_at timestamp_ntz",
    ).withColumn("status", F.lit("completed"))
    return docs, se.lexeme_table(docs)


def hits(library, q, **options):
    return se.search(*library, q, **options).collect()


def test_search_content_and_names(library):
    first = hits(library, "northern basin")
    assert [r.id for r in first] == ["A"] and first[0].matched_fields == ["content"] and "<mark>" in first[0].snippet
    typo = hits(library, "harbor")
    assert typo[0].id == "A" and typo[0].matched_fields == ["filename"] and typo[0].snippet is None
    assert hits(library, "Revised Toll")[0].id == "C"
    assert hits(library, "Lantern Survey")[0].id == "C"
    assert hits(library, "qjkxvvwz") == [] and hits(library, "   ") == []


def test_search_ranking_filter_and_prefix(library):
    assert [r.id for r in hits(library, "timetable")] == ["B", "A"]
    assert [r.id for r in hits(library, "timetable", document_type="report")] == ["A"]
    assert [r.id for r in hits(library, "north")] == ["A"]
    assert [r.id for r in hits(library, '"interim timetable"')][0] == "A"


@pytest.mark.parametrize("q", ["northern basin", "harbor", "Lantern Survey", "timetable", "-timetable", "qjkxvvwz", "Revised", "rev tol"])
def test_name_index_loses_nothing(library, q):
    docs, index = library
    plain = se.search_hits(docs, index, q).select("id", "score").collect()
    indexed = se.search_hits(docs, index, q, name_index=se.trigram_table(docs)).select("id", "score").collect()
    assert sorted(plain) == sorted(indexed)


def test_snippet_is_escaped(library):
    (d,) = [r for r in hits(library, "gadget stock") if r.id == "D"]
    assert "&lt;svg" in d.snippet and "<svg" not in d.snippet and "<mark>gadget</mark>" in d.snippet
    assert se._fragment_text("a & <b>", lambda w: False) == "a &amp; &lt;b"
    assert se._fragment_text("a&b <c>", lambda w: w == "b") == "a&amp;<mark>b</mark> &lt;c"


def test_query_parsing():
    T = se.Term
    assert se.websearch_query('cats or "the big dogs" -mouse') == [
        [T(("cat",), (0,))],
        [T(("big", "dog"), (0, 1)), T(("mous",), (0,), True)],
    ]
    assert se.websearch_query("the or -") == []
    assert se.prefix_query("a elec-x the") == ["elec"]
    assert se.matches_without_words("-draft") and not se.matches_without_words("x -draft")


def test_exclusion_only_query(library):
    docs, index = library
    out = se.content_match(docs, index, "-timetable").filter("content_match").select("id").collect()
    # The word beginnings still match where the excluded word occurs.
    assert {"C", "D"} <= {r.id for r in out}


def brute_rank(positions: dict[str, list[int]]) -> float:
    """Sum over smallest covers, tried one by one."""
    merged = sorted((p, w) for w, ps in positions.items() for p in ps)
    covers = []
    for i in range(len(merged)):
        for j in range(i, len(merged)):
            if {w for _, w in merged[i : j + 1]} == set(positions):
                covers.append((i, j))
                break
    smallest = [(i, j) for i, j in covers if not any((a, b) != (i, j) and i <= a and b <= j for a, b in covers)]
    return sum(0.1 / (1 + merged[j][0] - merged[i][0] - (j - i)) for i, j in smallest)


def test_cover_rank_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(30):
        places = rng.sample(range(1, 40), 12)
        positions = {"red": sorted(places[:4]), "blue": sorted(places[4:9]), "green": sorted(places[9:])}
        rows += [(doc, w, p) for w, p in positions.items()]
        want[doc] = brute_rank(positions)
    index = spark.createDataFrame(rows, "id int, lexeme string, positions array<int>")
    got = {r.id: r["rank"] for r in se.cover_rank(index, "red blue green", english=False).collect()}
    assert got == pytest.approx(want, abs=1e-7)


@pytest.mark.parametrize("english", [False, True])
def test_words_are_gathered_without_a_shuffle_of_words(spark, english):
    """Rows that share an id, or have none, meet; only texts are shuffled."""
    texts = [(1, "the red fox, the Red"), (1, "fox 9 red"), (None, "red"), (None, "red and"), (2, None), (3, "  "), (4, "x" * 5_000 + " y")]
    docs = spark.createDataFrame(texts, "id long, text string").selectExpr("id", "CAST(NULL AS string) AS title", "'' AS original_filename", "text")
    want = {}
    for id_, text in texts:
        for n, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower()), 1):
            if (form := se.normal_form(w, english)) is not None:
                want.setdefault((id_, form), []).append(n)
    index = se.lexeme_table(docs, english)
    plan = index._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "lexeme" not in shuffles[0]
    got = [((r.id, r.lexeme), r.positions) for r in index.collect()]
    assert len(got) == len(want) and dict(got) == {k: sorted(v) for k, v in want.items()}


def test_stems():
    pairs = "schedules schedul consistency consist generously generous relational relat hopping hop happy happi skies sky university univers"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_rank_fusion_and_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, embedding array<float>")
    top = se.vector_topk(vectors, [1.0, 0.0], 2).collect()
    assert [r.id for r in top] == [1, 2] and top[1].similarity == pytest.approx(0.6, abs=1e-6)
    a = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank_no int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id int, rank_no int")
    got = {r.id: r.rrf_score for r in se.reciprocal_rank_fusion([a, b]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62})


# -- rules ----------------------------------------------------------------------

RULES = [
    (1, "any", "foo  bar", False, True), (2, "all", "Alpha beta", True, True), (3, "all", "alpha nothere", True, False),
    (4, "literal", "alpha BAR", True, True), (5, "literal", "alpha bar", False, False), (6, "regex", "b.r\\b", True, True),
    (7, "regex", "(open", False, False), (8, "none", "alpha", True, False), (9, "any", "   ", True, False),
    (10, "fuzzy", "alpha", True, False), (11, "any", "lph", False, True), (12, "any", "", True, False),
]


def test_match_rules(spark):
    docs = spark.createDataFrame([("d", "t", None, "alpha BAR beta bar"), ("e", "u", None, "alpha")], "id string, tenant_id string, title string, text string")
    tags = spark.createDataFrame([(i, "t", a, m, s) for i, a, m, s, _ in RULES], "id int, tenant_id string, matching_algorithm string, match string, is_insensitive boolean")
    got = {(r.document_id, r.tag_id) for r in ru.match_tags(docs, tags).collect()}
    assert got == {("d", i) for i, *_, want in RULES if want}


def test_equal_rules_are_read_once(spark):
    """Many tags with few unlike rules: a text meets the unlike ones, and every tag of a rule that matches comes out."""
    rows = [(i, "t", "any", "alpha" if i % 2 else "nowhere", True) for i in range(2_500)] + [(7, "t", "literal", "beta", False), (9, "u", "any", "alpha", True)]
    tags = spark.createDataFrame(rows, "id int, tenant_id string, matching_algorithm string, match string, is_insensitive boolean")
    docs = spark.createDataFrame([("d", "t", None, "Alpha beta"), ("d", "t", None, "beta"), (None, "u", None, "alpha")], "id string, tenant_id string, title string, text string")
    packs = ru.rule_packs(ru.prepare_rules(tags)).select("tenant_id", F.size("rules").alias("n")).collect()
    assert sorted((r.tenant_id, r.n) for r in packs) == [("t", 3), ("u", 1)]
    got = sorted(((r.document_id, r.tag_id) for r in ru.match_tags(docs, tags).collect()), key=str)
    assert got == sorted([("d", i) for i in range(1, 2_500, 2)] + [("d", 7), ("d", 7), (None, 9)], key=str)


def test_first_correspondent_of_equal_rules(spark):
    """The earliest of equal rules and of equal names, also when a later pack holds it."""
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    rows = [(i, "t", f"name {i % 5}", "any", f"word{i % 1_500:04d}", at(5_000 - i)) for i in range(3_000)]
    people = spark.createDataFrame(rows, "id long, tenant_id string, name string, matching_algorithm string, match string, created_at timestamp_ntz").withColumn("is_insensitive", F.lit(True))
    docs = spark.createDataFrame(
        [(1, "t", None, "WORD0007 word1400", "x"), (2, "t", None, "word0003", " NAME 2 "), (3, "t", None, "none", None), (4, "t", None, "word1499", "name 0")],
        "id long, tenant_id string, title string, text string, vendor string",
    )
    want = {1: 2_900, 2: 2_997, 4: 2_999}
    assert {r.id: r.correspondent_id for r in ru.match_correspondents(docs, people).collect()} == want
    packs = ru.rule_packs(ru.prepare_rules(people).withColumn("place", F.struct("created_at", "id")), F.min("place").alias("place"))
    assert sorted(len(r.rules) for r in packs.collect()) == [500, 1_000]


def test_reapplied_rules_give_each_pair_once(spark):
    tags = spark.createDataFrame([(1, "t", "any", "alpha", True), (2, "t", "any", "alpha", True), (2, "t", "any", "beta", True)],
                                 "id long, tenant_id string, matching_algorithm string, match string, is_insensitive boolean")
    people = spark.createDataFrame([], "id long, tenant_id string, name string, email string, matching_algorithm string, match string, is_insensitive boolean, created_at timestamp_ntz")
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "alpha"), (None, "beta")], "id long, text string").selectExpr(
        "id", "'t' AS tenant_id", "CAST(NULL AS string) AS title", "text", "CAST(NULL AS timestamp) AS deleted_at", "'text/plain' AS mime_type", "CAST(NULL AS bigint) AS correspondent_id", "CAST(NULL AS string) AS vendor")
    bridge = spark.createDataFrame([(1, 2), (1, 5), (1, 5), (None, None)], "document_id long, tag_id long")
    pairs, _ = ru.apply_rules_to_existing(docs, tags, people, bridge)
    assert sorted(((r.document_id, r.tag_id) for r in pairs.collect()), key=str) == sorted([(1, 1), (1, 2), (1, 5), (None, 2), (None, None)], key=str)


def test_rule_text_cap(spark):
    df = spark.createDataFrame([("ab", "x" * 6000), (None, "y")], "title string, text string")
    got = [r[0] for r in df.select(ru.rule_text(F.col("title"), F.col("text"), 5000)).collect()]
    assert got[0] == "ab " + "x" * 4997 and got[1] == " y"


def test_senders(spark):
    cases = {
        'From: "Ana Li" <Ana@X.com>\nhi': ("Ana Li", "ana@x.com"),
        "Subject: s\nFrom: bob@x.com": (None, "bob@x.com"),
        "From: bob@x.com (Bob)": ("Bob", "bob@x.com"),
        "no header": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ru.parse_sender(F.col("t")).alias("s"))
    assert {r.t: tuple(r.s) for r in df.collect()} == cases
    people = spark.createDataFrame([(1, "t", "Ana", None), (2, "t", "Bob", "bob@x.com")], "id long, tenant_id string, name string, email string")
    senders = spark.createDataFrame(
        [(1, "t", "Bobby", "bob@x.com"), (2, "t", "Ana", "ana@x.com"), (3, "t", None, "ana@x.com"), (4, "t", "New", "n@x.com"), (5, "t", "New", "m@x.com"), (6, "t", "Z", "n@x.com")],
        "id long, tenant_id string, name string, email string",
    )
    links = ru.link_senders(senders, people)
    got = {r.id: (r.correspondent_id, r.new_name) for r in links.collect()}
    assert got == {1: (2, None), 2: (1, None), 3: (1, None), 4: (None, "New"), 5: (None, "New"), 6: (None, "New")}
    assert [tuple(r) for r in ru.new_correspondents(links).collect()] == [("t", "New", "n@x.com")]


def test_correspondent_by_name_or_rule(spark):
    people = spark.createDataFrame(
        [(1, "t", "Acme", "none", "", dt.datetime(2024, 1, 1)), (2, "t", "Beta", "literal", "zzz", dt.datetime(2024, 1, 2)), (3, "t", "Gamma", "any", "total", dt.datetime(2024, 1, 3))],
        "id long, tenant_id string, name string, matching_algorithm string, match string, created_at timestamp_ntz",
    ).withColumn("is_insensitive", F.lit(True))
    docs = spark.createDataFrame([(1, "t", None, "the total", " BETA "), (2, "t", None, "Total", "x"), (3, "t", None, "none", "Acme")],
                                 "id long, tenant_id string, title string, text string, vendor string")
    assert {r.id: r.correspondent_id for r in ru.match_correspondents(docs, people).collect()} == {1: 2, 2: 3}


# -- model answers -----------------------------------------------------------------


@pytest.mark.parametrize(
    "text, closed",
    [
        ('{"a":1,"items":[{"x":1},{"x":2', '{"a":1,"items":[{"x":1},{"x":2}]}'),
        ('{"a":"cut val', '{"a":"cut val"}'),
        ('{"a":1,"ke', '{"a":1}'),
        ('{"a":1,"key":', '{"a":1}'),
        ('{"a":1,', '{"a":1}'),
        ('{"a":["x","y', '{"a":["x"]}'),
        ('{"a":1,"done"', '{"a":1}'),
        ('{"k', "{}"),
    ],
)
def test_close_truncated(text, closed):
    assert close_truncated(text) == closed


def test_parse_model_output(spark):
    cases = [
        ('{"documentType":"Invoice","confidence":0.92,"fields":{"vendor":"T"}}', ("invoice", 0.92, "T")),
        ('```json\n{"fields":{"vendor":"F"}}\n```', ("other", 0.0, "F")),
        ('Result: {"documentType":"contract","confidence":1.5,"fields":{"vendor":"P"}} (end)', ("contract", 1.0, "P")),
        ('{"vendor":"ACME","total_amount":100,"document_type":"fax"}', ("other", 0.0, "ACME")),
        ('{"documentType":"receipt","fields":{"vendor":"Cut","items":[{"x":1},{"x":', ("receipt", 0.0, "Cut")),
        ('{"documentType":5,"fields":{}}', (None, None, None)),
        ("[1,2]", (None, None, None)),
        ("No field could be read.", (None, None, None)),
        (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, raw string")
    vendor = F.try_variant_get(F.try_element_at("fields", F.lit("vendor")), "$", "string").alias("v")
    got = mo.parse_model_output(df).select("i", "model_type", "confidence", vendor).collect()
    assert {r.i: (r.model_type, r.confidence, r.v) for r in got} == {i: w for i, (_, w) in enumerate(cases)}


def test_merge_chunks(spark):
    rows = [
        (1, 0, '{"documentType":"invoice","confidence":0.9,"fields":{"vendor":"ACME","total":50,"note":""}}'),
        (1, 1, '{"documentType":"invoice","confidence":0.9,"fields":{"line_items":[{"d":"A"}],"total":50,"vendor":"Z"}}'),
        (1, 2, '{"documentType":"receipt","confidence":0.7,"fields":{"line_items":[{"d":"B"}],"total":200,"note":"n"}}'),
        (2, 0, '{"confidence":0.2,"fields":{"note":""}}'),
    ]
    parts = mo.parse_model_output(spark.createDataFrame(rows, "document_id int, chunk_no int, raw string"))
    merged = {(r.document_id, r.key): r.value for r in mo.merge_chunk_fields(parts).collect()}
    assert merged == {
        (1, "vendor"): '"ACME"', (1, "total"): "200", (1, "line_items"): '[{"d":"A"},{"d":"B"}]', (1, "note"): '"n"', (2, "note"): '""',
    }
    head = {r.document_id: (r.model_type, round(r.confidence, 4)) for r in mo.merge_chunk_header(parts).collect()}
    assert head == {1: ("invoice", 0.8333), 2: ("other", 0.2)}


def test_merge_pages(spark):
    rows = [
        (1, 1, '{"v":{"name":"","x":1},"total":1,"items":[1],"page":"a"}', None),
        (1, 2, '{"v":{"name":"B","x":2},"total":"","items":[2],"page":"b","validation_errors":["e"]}', None),
        (1, 3, '{"total":3}', "boom"),
    ]
    pages = spark.createDataFrame(rows, "document_id int, page_no int, data string, error string")
    import json

    (out,) = mo.assemble(mo.merge_pages(pages)).collect()
    assert json.loads(out.data) == {"v": {"name": "B", "x": 1}, "total": 3, "items": [1, 2], "page": "a"}
    (errors,) = mo.page_errors(pages).collect()
    assert errors.validation_errors == ["Page 3 failed to process: boom", "e"]


def test_merge_pages_of_mixed_kinds(spark):
    import json

    cases = {
        1: (['{"v":"text"}', '{"v":{"a":1}}'], {"v": "text"}),
        2: (['{"v":""}', '{"v":{"a":1}}', '{"v":{"b":2}}'], {"v": {"a": 1, "b": 2}}),
        3: (['{"total":{"net":1}}', '{"total":5}', '{"total":{"net":7}}', '{"total":""}'], {"total": {"net": 7}}),
        4: (['{"v":[1]}', '{"v":2}', '{"v":[3]}'], {"v": [1, 3]}),
        5: (['{"validation_errors_count":2,"validation_errors":["e"]}', "broken", "[1]"], {"validation_errors_count": 2}),
        6: (['{"v":{"w":null}}', '{"v":{"w":{"deep":"x"}}}'], {"v": {"w": {"deep": "x"}}}),
    }
    rows = [(d, p, text) for d, (texts, _) in cases.items() for p, text in enumerate(texts)] + [(7, 0, None)]
    pages = spark.createDataFrame(rows, "document_id int, page_no int, data string")
    got = {r.document_id: json.loads(r.data) for r in mo.assemble(mo.merge_pages(pages)).collect()}
    assert got == {d: want for d, (_, want) in cases.items()}


def test_validation(spark):
    ok = '{"vendor_details":{"company_name":"A"},"financials":{"subtotal":100.0,"tax_amount":10.0,"total_amount":%s}}'
    rows = [(1, ok % "110.0"), (2, ok % "125.0"), (3, '{"x":1}'), (4, '{"vendor_name":"A","SubTotal":1,"VAT":1,"Total":9,"validation_errors":["old"]}')]
    df = spark.createDataFrame(rows, "id int, data string")
    got = {r.id: (r.requires_human_review, r.validation_errors) for r in mo.validate_extraction(df).collect()}
    assert got[1] == (False, []) and got[3] == (True, ["Missing Vendor Name"]) and got[4] == (False, ["old"])
    assert got[2] == (True, ["Math mismatch: Subtotal(100.0) + Tax(10.0) != Total(125.0)"])
    far = {r.id: r.validation_errors for r in mo.validate_extraction(df, remote=True).collect()}
    assert far[4] == ["old", "Math mismatch: Subtotal(1.0) + Tax(1.0) != Total(9.0)"]
    schema = df.withColumn("s", F.lit('{"amount":0}'))
    assert {r.id: r.validation_errors for r in mo.validate_extraction(schema, schema="s").collect()}[3] == []


def test_structure_and_key_order(spark):
    df = spark.createDataFrame([('{"line_items":[1],"z":1}', '{"line_items":[],"flag":true,"name":"x","sub":{}}')], "d string, s string")
    full = df.select(mo.ensure_structure(F.col("d")), mo.ensure_structure(F.col("d"), F.col("s"))).first()
    assert '"vendor_details":{}' in full[0] and '"line_items":[1]' in full[0] and '"requires_human_review":false' in full[0]
    assert '"name":null' in full[1] and '"sub":{}' in full[1] and '"flag":0' in full[1]
    nested = spark.createDataFrame([('{"b":1,"a":{"y":1,"x":{"q":1}},"c":{"k":1}}', '{"a":{"x":0,"y":0},"b":0}')], "d string, s string")
    got = nested.select(order_keys_by_schema(F.col("d"), F.col("s"))).first()[0]
    assert got == '{"a": {"x": {"q": 1}, "y": 1}, "b": 1, "c": {"k": 1}}'


def test_clean_html_text(spark):
    html = "Hello <img src='foo.png'> World\n \n\n<table>\n<tr><th>Item</th><th>Price</th></tr>\n<tr><td>A &amp; <b>B</b></td><td>1.00</td></tr></table> <table border=1><tr><td>k</td></tr></table>"
    out = spark.createDataFrame([(html,), ("<table></table>",)], "h string").select(mo.clean_html_text(F.col("h"))).collect()
    assert out[0][0] == "Hello  World\n\n| Item | Price |\n| --- | --- |\n| A &B | 1.00 | <table border=1><tr><td>k</td></tr></table>"
    assert out[1][0] == "<table></table>"


# -- files and streams ----------------------------------------------------------------

INVOICE = """<?xml version="1.0"?>
<p:Invoice xmlns:p="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:c="urn:c" xmlns:b="urn:b">
  <b:ID>INV-7</b:ID><b:IssueDate>2026-06-15Z</b:IssueDate><b:DocumentCurrencyCode>MYR</b:DocumentCurrencyCode>
  <c:AccountingSupplierParty><c:Party><c:PartyName><b:Name> Trade </b:Name></c:PartyName></c:Party></c:AccountingSupplierParty>
  <c:InvoiceLine><b:InvoicedQuantity>2</b:InvoicedQuantity><c:Item><b:Name>A</b:Name></c:Item></c:InvoiceLine>
  <c:InvoiceLine><b:LineExtensionAmount>x</b:LineExtensionAmount><c:Price><b:PriceAmount>1.5</b:PriceAmount></c:Price></c:InvoiceLine>
  <c:LegalMonetaryTotal><b:PayableAmount currencyID="MYR">200.00</b:PayableAmount></c:LegalMonetaryTotal>
</p:Invoice>"""


def test_ubl(spark):
    rows = [(1, INVOICE), (2, INVOICE + "<more>"), (3, INVOICE.replace("Invoice-2", "Order-2")), (4, "<!DOCTYPE x>" + INVOICE), (5, "<a>"), (6, None)]
    out = fl.read_ubl_invoices(spark.createDataFrame(rows, "id int, xml string")).collect()
    assert [r.id for r in out] == [1]
    r = out[0]
    assert (r.vendor, r.invoice_number, r.invoice_date, r.due_date, r.total_amount) == ("Trade", "INV-7", dt.date(2026, 6, 15), None, 200.0)
    assert [tuple(i) for i in r.line_items] == [("A", 2.0, None, None), (None, None, 1.5, None)]


def test_xml_text(spark):
    rows = [(1, '<a x="1>2">A&amp;B <b>c&#233;&#x20AC;</b><!-- no --><![CDATA[<raw>]]> z</a>'), (2, "<a></b>"), (3, "<a>x</a> t"), (4, "<!ENTITY a><a>x</a>")]
    got = {r.id: r.xml_text for r in fl.flatten_xml_text(spark.createDataFrame(rows, "id int, xml string")).collect()}
    assert got == {1: "A&B cé€ <raw> z", 2: "", 3: "", 4: ""}


def test_folder_intake(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", "x")
    for name, data in {
        "a.txt": b"hello", "b.txt": b"hello", "c.exe": b"%PDF-1", "d.docx": book.getvalue(), "e.zip": b"PK\x03\x04junk", "f.md": "é".encode("latin-1") * 9,
        "g.bin": bytes(range(128, 160)), "h.eml": b"From: a@b.c\nTo: d@e.f\n\nx",
    }.items():
        (tmp_path / name).write_bytes(data)
    known = spark.createDataFrame([("t", "0" * 64)], "tenant_id string, checksum string")
    out = fl.ingest_files(spark, str(tmp_path), "t", known)
    kept = {r.title: r.mime_type.rsplit("/", 1)[-1].rsplit(".", 1)[-1] for r in out["documents"].collect()}
    assert kept == {"a.txt": "plain", "c.exe": "pdf", "d.docx": "sheet", "f.md": "markdown", "h.eml": "rfc822"}
    assert {r.filename: r.reject_reason for r in out["rejected"].collect()} == {"e.zip": "unsupported_type", "g.bin": "unsupported_type"}


def test_stream_intake_restarts_cleanly(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "id long, tenant_id string, text string, ocr_confidence double"

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))

    put("one", [(1, "t", "INVOICE\nInvoice No: A-1\nDate: 2024-01-01\nTotal: 5.00", None), (2, "t", "memo", None), (3, "t", "memo", None)])
    path, state = shared_folder(spark, "intake"), shared_folder(spark, "state")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        query = stream_ingest(stream, path, state)
        assert query.awaitTermination(120)

    run()
    put("two", [(4, "t", "memo", None), (5, "u", "memo", None), (6, "t", "receipt", None)])
    run()
    rows = {r.id: (r.status, r.gate_passed) for r in spark.read.parquet(path).collect()}
    assert rows == {1: ("completed", True), 2: ("completed", None), 5: ("completed", None), 6: ("needs_review", False)}
    # The same batch again replaces its own rows only.
    batch_writer(path)(spark.createDataFrame([(6, "t", "receipt", None), (5, "u", "memo", None)], schema), 1)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 5, 6]


def test_ubl_checks_a_text_once(spark):
    # F16: the check of the whole text was copied into each of its mentions.
    body = UBL_BODY.format(head="")
    rows = [
        (1, body), (2, f"<!-- <!DOCTYPE x> -->{body}"), (3, f"<!DOC<!-- -->TYPE x>{body}"), (4, f"<!ENTITY x>{body}"),
        (5, body.replace("Invoice-2", "Order-2")), (6, body + "<open>"), (7, None), (8, UBL_BODY.format(head="<!-- <!DOCTYPE x> -->")),
    ]
    out = fl.read_ubl_invoices(spark.createDataFrame(rows, "id int, xml string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("(?s)<!--.*?-->") == 1
    got = {r.id: (r.invoice_number, r.line_items[0].quantity, r.line_items[0].amount) for r in out.collect()}
    assert got == dict.fromkeys((1, 2, 8), ("A", 2.0, None))


UBL_BODY = (
    '<Invoice xmlns="urn:oasis:names:specification:ubl:schema:xsd:Invoice-2" xmlns:b="urn:b">{head}<b:ID> A </b:ID>'
    "<b:InvoiceLine><b:InvoicedQuantity> 2 </b:InvoicedQuantity><b:LineExtensionAmount>x</b:LineExtensionAmount></b:InvoiceLine></Invoice>"
)
