"""The stored index: tenants, pruning, edits, merges; the rank of a whole query."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import search as se
from ledgerloom.operators import search_index as si
from ledgerloom.operators.search_index import SearchIndex
from ledgerloom.session import materialise, shared_folder
from ledgerloom.sources.catalog import Catalog

DAY = datetime.datetime(2024, 3, 1)
COLUMNS = "tenant_id string, id long, title string, original_filename string, document_type string, status string, uploaded_at timestamp, deleted_at timestamp, text string"


def document(tenant, key, title, text, deleted=None):
    return (tenant, key, title, f"file {key}.pdf", "report", "completed", DAY + datetime.timedelta(minutes=key), deleted, text)


ROWS = [
    document("a", 1, "Harbour ledger", "running costs of the northern harbour rose"),
    document("a", 2, "Crane survey", "the cranes were surveyed and the harbour closed"),
    document("a", 3, None, "nothing about ships, only alpha"),
    document("a", 4, "Old harbour", "trashed harbour text", DAY),
    document("b", 5, "Harbour ledger", "harbour harbour harbour"),
    document("b", 6, "Alpha", "alpha beta"),
    document("007", 7, "Numbered tenant", "harbour of a tenant whose name is a number"),
    document("a", 8, None, None),
]


def build(spark):
    docs = spark.createDataFrame(ROWS, COLUMNS).coalesce(1)
    return SearchIndex.build(Catalog(spark, shared_folder(spark, "test-index")), docs, spans=4, slots=4)


@pytest.fixture(scope="module")
def index(spark):
    """Only read."""
    return build(spark)


@pytest.fixture
def edited_index(spark):
    return build(spark)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_a_tenant_finds_what_a_search_of_its_rows_finds(spark, index):
    for tenant in ("a", "b", "007"):
        docs = spark.createDataFrame([r for r in ROWS if r[0] == tenant], COLUMNS)
        for q in ("run cost", '"the harbour" -alpha', "alpha or harbr ledger")[: 3 if tenant == "a" else 1 if tenant == "b" else 2]:
            want = se.search(docs, se.lexeme_table(docs), q, name_index=se.trigram_table(docs))
            got = index.search(tenant, q)
            assert [(r["id"], r["score"], r["matched_fields"], r["snippet"]) for r in got.collect()] == [
                (r["id"], r["score"], r["matched_fields"], r["snippet"]) for r in want.collect()
            ]


def test_no_tenant_and_foreign_tenants_find_nothing(index):
    assert ids(index.search(None, "harbour")) == ids(index.search("", "harbour")) == ids(index.search("c", "harbour")) == []
    assert set(ids(index.search("b", "harbour"))) == {5}
    assert ids(index.search("b", "  ")) == []


def test_only_the_tenants_spans_and_words_are_read(spark, index):
    words = index.words("a", "harbour")
    plan = words._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/words" in line]
    assert scans and all("tenant_id" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)[1] for line in scans)
    assert all("span" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)[1] for line in scans)
    assert any(re.search(r"PushedFilters: \[[^\]]*lexeme", line) for line in scans)
    read, there = len(words.inputFiles()), len(index.catalog.system("words").inputFiles())
    assert 0 < read and there > 4
    # A page opens its own slots of the texts only.
    found = index.search("a", "harbour")
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_edits_are_searchable_before_and_after_the_merge(spark, edited_index):
    index = edited_index
    def renamed(key, title):
        (old,) = [r for r in ROWS if r[1] == key]
        return (*old[:2], title, *old[3:])

    edited = spark.createDataFrame([renamed(1, "Quay budget"), renamed(6, "Gamma")], COLUMNS)
    gone = spark.createDataFrame([("a", 3)], "tenant_id string, id long")

    def now(rows):
        return spark.createDataFrame(rows, COLUMNS)

    for _ in range(2):  # a repeated version replaces itself
        index.apply(1, edited, gone)
    current = [renamed(1, "Quay budget") if r[1] == 1 else renamed(6, "Gamma") if r[1] == 6 else r for r in ROWS if r[1] != 3]

    def check(opened):
        assert ids(opened.search("a", "quay", documents=now(current))) == [1]
        assert "1" not in map(str, ids(opened.words("a", "ledger").select("id")))
        assert ids(opened.search("a", "northern", documents=now(current))) == [1]
        assert ids(opened.search("a", "alpha", documents=now(current))) == []
        assert ids(opened.search("b", "gamma", documents=now(current))) == [6]
        assert ids(opened.search("b", "beta", documents=now(current))) == [6]
        assert set(ids(opened.search("b", "harbour", documents=now(current)))) == {5}

    check(index)
    before = {f for f in index.catalog.system("words").inputFiles() if "tenant_id=007" in f}
    touched = index.merge(1)
    assert {r["tenant_id"] for r in touched.collect()} == {"a", "b"}
    # Untouched ranges keep their files.
    assert before == {f for f in index.catalog.system("words").inputFiles() if "tenant_id=007" in f}
    again = SearchIndex.open(index.catalog)
    assert (again.bounds, again.english, again.slots) == (index.bounds, True, 4)
    check(again)
    # An edit after the merge stands beside it.
    again.apply(2, now([renamed(1, "Dock")]))
    latest = [renamed(1, "Dock") if r[1] == 1 else r for r in current]
    assert ids(again.search("a", "dock", documents=now(latest))) == [1]
    assert ids(again.search("a", "quay", documents=now(latest))) == []


def test_a_merge_that_is_run_again_changes_nothing(spark, edited_index):
    index = edited_index
    edited = spark.createDataFrame([(*ROWS[0][:2], "Quay", *ROWS[0][3:])], COLUMNS)
    index.apply(1, edited)
    index.merge(1)
    want = sorted(map(tuple, index.catalog.system("words").where("id IS NOT NULL").select("tenant_id", "id", "lexeme").collect()))
    # As after a stop between the rewrite and the state: version 1 is still open.
    index.catalog.create("state", index._state(0))
    assert sorted((r["lexeme"], r["id"]) for r in index.words("a", "quay").collect()) == [("quay", 1)]
    index.merge(1)
    assert want == sorted(map(tuple, index.catalog.system("words").where("id IS NOT NULL").select("tenant_id", "id", "lexeme").collect()))


def merged(spark, monkeypatch, most):
    """What a merge leaves, what a new index of the same documents has, and the rows that met the edits by id."""
    written = {}
    monkeypatch.setattr(si, "EDIT_BITS", most)

    def keep(session, df, purpose):
        written[purpose] = materialise(session, df, purpose)
        return written[purpose]

    monkeypatch.setattr(si, "materialise", keep)
    texts = [f"alpha w{i % 7} w{i % 5} x{i}" for i in range(300)]
    rows = [document(("a", "b", "c")[i % 3], i, f"Title {i}", texts[i]) for i in range(300)] + [document("lone", 1000, "Only", "single words"), document(None, 1001, "None", "no tenant")]
    docs = spark.createDataFrame(rows, COLUMNS)
    make = lambda d: SearchIndex.build(Catalog(spark, shared_folder(spark, "test-index")), d, english=False, spans=3, slots=2)
    index = make(docs)
    gone = docs.where("id IN (4, 5, 1000)").select("tenant_id", "id")
    # The same id under another tenant is not the edited document.
    other = spark.createDataFrame([("b", 3)], "tenant_id string, id long")
    edited = docs.where("id IN (10, 11)").selectExpr("tenant_id", "id", "'New name' AS title", "original_filename", "'gamma alpha' AS text")
    index.apply(1, edited, gone.unionByName(other))
    index.merge(1)
    now = docs.where("id NOT IN (4, 5, 10, 11, 1000)").select(*edited.columns).unionByName(edited)
    fresh = make(now)

    def state(i, name):
        return sorted((tuple(map(str, r)) for r in i.catalog.system(name).where("id IS NOT NULL AND tenant_id IS NOT NULL").drop("span").collect()))

    return [(state(index, n), state(fresh, n)) for n in ("words", "names")], written, index


@pytest.mark.parametrize("most", [1 << 25, 64, 0])
def test_a_merge_equals_a_new_index(spark, monkeypatch, most):
    # every row of the index met the edits by id, twice, and was written twice.  Fewer bits than documents tell nothing.
    tables, written, index = merged(spark, monkeypatch, most)
    assert all(got == want and got for got, want in tables)
    assert not [name for name in written if name.startswith("merged")]
    all_rows = len(tables[0][0])
    assert written["doubtful-words"].count() < (all_rows / 4 if most > 64 else all_rows if most else 2 * all_rows)
    assert ("edit-bits" in written) == (most > 0)
    voids = index.catalog.system("words").where("id IS NULL").select("tenant_id").distinct().collect()
    assert [r["tenant_id"] for r in voids] == ["lone"]


def test_trigrams_are_those_of_each_padded_word(spark):
    # trigrams were cut out one by one.
    names = ["Harbour ledger-07", "", " a  \U00010400\U00010428b\nZ ", "--", "x", "\u00c9t\u00e9 \u0130stanbul", "tab\tand\r\nline", None, "12.5%", "\U0001d400\U00010400 \U0001f600a"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    apart = F.regexp_extract_all(F.lower("name"), F.lit(se.WORD), 0)
    rows = df.select("id", apart.alias("words"), se.trigram_column(F.col("name")).alias("grams")).collect()
    for r in rows:
        want = None if r["words"] is None else [f"  {w} "[i : i + 3] for w in r["words"] for i in range(len(w) + 1)]
        assert r["grams"] == want
    plan = df.select(se.trigram_column(F.col("name")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan


@pytest.mark.parametrize("english", [True, False])
def test_words_are_sorted_without_a_comparator(spark, english):
    # the words of a document were sorted by an expression called for every two of them.
    docs = spark.createDataFrame([(1, "b a", None, "a c \u00e9 a"), (1, None, None, "a d"), (2, None, None, None)], "id long, title string, original_filename string, text string")
    index = se.lexeme_table(docs, english)
    assert "array_sort(" not in index._jdf.queryExecution().optimizedPlan().toString().replace("sort_array(", "")
    got = {(r["id"], r["lexeme"]): r["positions"] for r in index.collect()}
    want = {(1, "a"): [1, 2, 3, 6], (1, "b"): [1], (1, "c"): [4], (1, "d"): [2], (1, "\u00e9"): [5]}
    assert got == {k: v for k, v in want.items() if not english or k[1] != "a"}


def test_scoped_ids_and_appends(spark, edited_index):
    index = edited_index
    scope = index.catalog.scope("a")
    wanted = spark.createDataFrame([(1,), (5,), (7,), (99,)], "id long")
    assert ids(scope.own(wanted)) == [1]
    assert ids(index.catalog.scope(None).own(wanted)) == []
    extra = spark.createDataFrame([document("a", 20, "x", "y"), document("b", 21, "x", "y")], COLUMNS).drop("text")
    scope.append("documents", extra)
    assert {20, 21} & set(ids(index.catalog.system("documents"))) == {20}


@pytest.mark.parametrize(
    ("q", "text", "rank"),
    [
        ("alpha or alpha beta", "alpha beta", 0.1),
        ("alpha", "alpha beta", 0.1),
        ("alpha beta", "alpha x y beta", 0.1 / 3),
        ("alpha or beta", "alpha x beta", 0.2),
        ("alpha beta or gamma", "alpha gamma beta", 0.1),
        ("alpha -gamma or beta", "alpha beta", 0.2),
    ],
)
def test_a_document_is_paid_once_for_all_alternatives(spark, q, text, rank):
    docs = spark.createDataFrame([(1, None, None, text)], "id long, title string, original_filename string, text string")
    (row,) = se.cover_rank(se.lexeme_table(docs, english=False), q, english=False).collect()
    assert row["rank"] == pytest.approx(rank, abs=1e-9)


def smallest_covers(words, groups):
    """Smallest runs of words that hold all words of a group, by trying every run."""
    runs = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if any(set(g) <= set(words[i : j + 1]) for g in groups)]
    return [r for r in runs if not any(o != r and r[0] <= o[0] and o[1] <= r[1] for o in runs)]


def test_rank_equals_brute_force_over_alternatives(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices(["red", "blue", "green", "x"], k=rng.randint(1, 14))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "NULL AS title", "NULL AS original_filename", "text")
    got = {r["id"]: r["rank"] for r in se.cover_rank(se.lexeme_table(docs, english=False), "red blue or green", english=False).collect()}
    used = {"red", "blue", "green"}
    for key, text in enumerate(texts):
        words = text.split()
        covers = smallest_covers(words, [["red", "blue"], ["green"]])
        want = sum(0.1 / (1 + sum(w not in used for w in words[i : j + 1])) for i, j in covers)
        assert got.get(key, 0) == pytest.approx(want, abs=1e-8)
