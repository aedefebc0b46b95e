"""Text search and vector ranking (B12, F2, I, K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as flt
from ..operators import maintain as mt
from ..operators import search as se
from ..operators.search_index import SearchIndex
from ..session import materialise, shared_folder
from ..sources.archive import Archive
from ..sources.catalog import Catalog
from .registry import query

QUERY = '"of the" thing or nicht -und'
PREFIX = "thou er"
NAME = "memo srk1"
RANKED = "thing the"

_TOKENS = """, doc AS (SELECT *, concat_ws(' ', nullif(title, ''), nullif(original_filename, ''), nullif(text, '')) AS st FROM texts),
tok AS (SELECT id, unnest(regexp_extract_all(lower(st), '[\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(st), '[\\p{L}\\p{N}]+'), 1) AS pos FROM doc)"""


def _index(a: Archive, english: bool = False):
    return se.lexeme_table(a.table("texts", heavy=True), english)


query(
    "i01_search_text",
    "texts",
    "SELECT id, concat_ws(' ', nullif(title, ''), nullif(original_filename, ''), nullif(text, '')) AS search_text FROM texts",
)(
    lambda a: a.table("texts", heavy=True).select(
        "id", se.search_text(F.col("title"), F.col("original_filename"), F.col("text")).alias("search_text")
    )
)

query(
    "i02_lexemes_plain",
    "texts",
    f"{_TOKENS} SELECT id, w AS lexeme, string_agg(pos, ',' ORDER BY pos) AS positions FROM tok GROUP BY ALL",
)(lambda a: _index(a).select("id", "lexeme", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions")))

query("i02_lexemes_english")(
    lambda a: _index(a, True).select("id", "lexeme", F.size("positions").alias("n"), F.array_min("positions").alias("first_position"))
)

_MATCH = f"""{_TOKENS}, flag AS (SELECT id,
  EXISTS (SELECT 1 FROM tok x JOIN tok y ON y.id = x.id AND y.pos = x.pos + 1 WHERE x.id = doc.id AND x.w = 'of' AND y.w = 'the')
    AND EXISTS (SELECT 1 FROM tok x WHERE x.id = doc.id AND x.w = 'thing')
    OR EXISTS (SELECT 1 FROM tok x WHERE x.id = doc.id AND x.w = 'nicht') AND NOT EXISTS (SELECT 1 FROM tok x WHERE x.id = doc.id AND x.w = 'und') AS by_words,
  NOT EXISTS (SELECT 1 FROM (VALUES ('of'), ('the'), ('thing'), ('or'), ('nicht'), ('und')) v(p) WHERE NOT EXISTS (
    SELECT 1 FROM tok x WHERE x.id = doc.id AND starts_with(x.w, v.p))) AS by_prefix FROM doc)"""
query("i03_websearch_query", "texts", f"{_MATCH} SELECT id FROM flag WHERE by_words")(
    lambda a: se.content_flags(_index(a), QUERY, english=False).filter("by_words").select("id")
)

query(
    "i04_prefix_query",
    "texts",
    f"""{_TOKENS} SELECT id FROM tok GROUP BY id HAVING bool_or(starts_with(w, 'thou')) AND bool_or(starts_with(w, 'er'))""",
)(lambda a: se.content_flags(_index(a), PREFIX, english=False).filter("by_prefix").select("id"))

query("i05_content_match", "texts", f"{_MATCH} SELECT id, by_words OR by_prefix AS content_match FROM flag")(
    lambda a: se.content_match(a.table("texts", heavy=True).select("id"), _index(a), QUERY, english=False)
)


def _similarity_sql(q: str) -> str:
    grams = ", ".join(f"'{t}'" for t in sorted(set(se.trigrams(q))))
    n = len(set(se.trigrams(q)))
    return f""", names AS (SELECT id, unnest([coalesce(title, original_filename), original_filename]) AS nm FROM texts),
gr AS (SELECT id, nm, flatten(list_transform(regexp_extract_all(lower(nm), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w)::BIGINT + 2), lambda i: substring('  ' || w || ' ', i, 3)))) AS g FROM names),
sp AS (SELECT DISTINCT id, nm, g, i FROM gr, unnest(range(1, len(g) + 1)) t(i) WHERE g[i] IN ({grams})),
ext AS (SELECT a.id, list_distinct(a.g[a.i:b.i]) AS run FROM sp a JOIN sp b ON a.id = b.id AND a.nm = b.nm AND a.i <= b.i),
sim AS (SELECT id, max(len(list_intersect(run, [{grams}]))::DOUBLE / (len(run) + {n} - len(list_intersect(run, [{grams}])))) AS s FROM ext GROUP BY 1)"""


query(
    "i06_name_similarity",
    "texts",
    f"{_similarity_sql(NAME)} SELECT t.id, round(coalesce(s, 0), 9) AS similarity, coalesce(s, 0) >= 0.2 AS matches FROM texts t LEFT JOIN sim USING (id)",
)(
    lambda a: a.table("texts", heavy=True)
    .select("id", F.explode(F.array(se.name_similarity(NAME))).alias("s"))
    .select("id", F.round("s", 9).alias("similarity"), (F.col("s") >= se.NAME_THRESHOLD).alias("matches"))
)

_RANK = f"""{_TOKENS}, hit AS (SELECT id, w, pos, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM tok WHERE w IN ('thing', 'the')),
run AS (SELECT id, pos, n, max(CASE WHEN w = 'thing' THEN pos END) OVER k AS a, max(CASE WHEN w = 'the' THEN pos END) OVER k AS b FROM hit
  WINDOW k AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cov AS (SELECT id, least(a, b) AS p, min(pos) AS q, min(n) AS nq FROM run WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
rank AS (SELECT cov.id, sum(round(0.1::DOUBLE / (1 + (q - p) - (nq - hit.n)) * 1000000000)::BIGINT) / 1000000000.0::DOUBLE AS rank
  FROM cov JOIN hit ON hit.id = cov.id AND hit.pos = cov.p GROUP BY 1)"""
query("i07_cover_rank", "texts", f"{_RANK} SELECT id, rank FROM rank")(
    lambda a: se.cover_rank(_index(a), RANKED, english=False)
)

query("i08_snippet")(lambda a: _snippets(a))


def _snippets(a: Archive):
    docs = a.table("texts", heavy=True)
    flagged = se.content_match(docs.select("id", "text"), _index(a, True), RANKED)
    return flagged.filter("content_match").select("id", se.snippet(RANKED, F.col("text"), F.col("content_match")).alias("snippet"))


_HITS = f"""{_RANK}{_similarity_sql(RANKED)}, pre AS (SELECT id FROM tok GROUP BY 1 HAVING bool_or(starts_with(w, 'thing')) AND bool_or(starts_with(w, 'the'))),
hits AS (SELECT t.id, t.uploaded_at, t.document_type, t.status, pre.id IS NOT NULL AS c, coalesce(s, 0) >= 0.2 AS f, coalesce(rank, 0) + coalesce(s, 0) AS score
  FROM texts t LEFT JOIN pre USING (id) LEFT JOIN sim USING (id) LEFT JOIN rank USING (id) WHERE t.deleted_at IS NULL AND (pre.id IS NOT NULL OR coalesce(s, 0) >= 0.2)),
shown AS (SELECT *, array_to_string(list_filter([CASE WHEN c THEN 'content' END, CASE WHEN f THEN 'filename' END], lambda x: x IS NOT NULL), ',') AS matched_fields FROM hits)"""


def _hits(a: Archive):
    # The index is read three times: write it once, as intake would.
    index = materialise(a.spark, _index(a), "lexemes")
    return se.search_hits(a.table("texts", heavy=True).drop("text"), index, RANKED, english=False)


query(
    "f02_sort_relevance",
    "texts",
    f"{_HITS} SELECT id, round(score, 6) AS score, matched_fields FROM shown ORDER BY score DESC, uploaded_at DESC, id",
)(
    lambda a: flt.sort_documents(_hits(a), None, ranked=True).select(
        "id", F.round("score", 6).alias("score"), F.array_join("matched_fields", ",").alias("matched_fields")
    )
)

_PAGE = f"""{_HITS} SELECT id, round(score, 6) AS score, matched_fields, c AS has_snippet FROM shown WHERE document_type = 'report'
ORDER BY score DESC, uploaded_at DESC, id LIMIT 20"""


def _search_page(a: Archive, with_names: bool):
    docs = a.table("texts", heavy=True)
    index = materialise(a.spark, se.lexeme_table(docs, english=False), "lexemes")
    names = se.trigram_table(docs) if with_names else None
    found = se.search(docs, index, RANKED, document_type="report", english=False, name_index=names)
    return found.select(
        "id",
        F.round("score", 6).alias("score"),
        F.array_join("matched_fields", ",").alias("matched_fields"),
        F.coalesce(F.col("snippet").contains("<mark>"), F.lit(False)).alias("has_snippet"),
    )


query("i09_search", "texts", _PAGE)(lambda a: _search_page(a, with_names=False))
query("i09_search_by_indexes", "texts", _PAGE)(lambda a: _search_page(a, with_names=True))

query(
    "b12_text_search_filter",
    "texts",
    f"{_HITS} SELECT id FROM shown WHERE status = 'completed'",
)(
    lambda a: se.search_hits(
        a.table("texts", heavy=True).filter("status = 'completed'").drop("text"), materialise(a.spark, _index(a), "lexemes"), RANKED, english=False
    ).select("id")
)

# -- stored index ------------------------------------------------------------------


def _stored(a: Archive, docs) -> SearchIndex:
    # Few spans and slots: 25 tenants share a table of some megabytes.
    return SearchIndex.build(Catalog(a.spark, shared_folder(a.spark, "index")), docs, english=False, spans=4, slots=4)


query(
    "i09_search_stored_index",
    "texts",
    _PAGE.replace("WHERE document_type = 'report'", "WHERE document_type = 'report' AND tenant_id = 't3'").replace("SELECT t.id,", "SELECT t.id, t.tenant_id,"),
)(lambda a: _stored_page(a))


def _stored_page(a: Archive):
    found = _stored(a, a.table("texts", heavy=True)).search("t3", RANKED, document_type="report")
    return found.select(
        "id",
        F.round("score", 6).alias("score"),
        F.array_join("matched_fields", ",").alias("matched_fields"),
        F.coalesce(F.col("snippet").contains("<mark>"), F.lit(False)).alias("has_snippet"),
    )


def _renamed(docs, share: int, title):
    """Documents of every ``share``-th id under a new title."""
    patches = docs.where(F.col("id") % share == 0).select(
        "id", F.array(F.lit("title")).alias("keys"), title.alias("title"), *[F.lit(None).cast(t).alias(c) for c, t in _UNCHANGED.items()]
    )
    whole = docs.withColumns({c: F.lit(None).cast(t) for c, t in _UNCHANGED.items() if c not in docs.columns and c != "data_patch"})
    whole = whole.withColumn("extracted_data", F.lit(None).cast("string"))
    return mt.patch_documents(whole, patches).where("reindex").select(*docs.columns)


_UNCHANGED = {"document_type": "string", "document_date": "date", "correspondent_id": "bigint", "data_patch": "string"}

query(
    "k08_index_upkeep",
    "texts",
    """, now AS (SELECT id, tenant_id, concat_ws(' ', nullif(CASE WHEN id % 5 = 0 THEN 'Again ' || id WHEN id % 3 = 0 THEN 'Renamed ' || id || ' note' ELSE title END, ''),
  nullif(original_filename, ''), nullif(text, '')) AS st FROM texts WHERE deleted_at IS NULL),
tok AS (SELECT id, tenant_id, unnest(regexp_extract_all(lower(st), '[\\p{L}\\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(st), '[\\p{L}\\p{N}]+'), 1) AS pos FROM now)
SELECT tenant_id, id, w AS lexeme, string_agg(pos, ',' ORDER BY pos) AS positions FROM tok WHERE w IN ('again', 'renamed', 'note', 'memo', 'the') GROUP BY ALL""",
)(lambda a: _upkeep(a))


def _upkeep(a: Archive):
    docs = a.table("texts", heavy=True)
    index = _stored(a, docs)
    # Two rounds of edits; the first becomes part of the index, the second and the removals stay beside it.
    first = _renamed(docs, 3, F.concat(F.lit("Renamed "), F.col("id"), F.lit(" note")))
    index.apply(1, first)
    index.merge(1)
    index.apply(2, _renamed(docs, 5, F.concat(F.lit("Again "), F.col("id"))).where("deleted_at IS NULL"), docs.where("deleted_at IS NOT NULL"))
    found = index.current_words(F.col("lexeme").isin("again", "renamed", "note", "memo", "the"))
    return found.select("tenant_id", "id", "lexeme", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


# -- vectors -----------------------------------------------------------------------

_COS = """, q AS (SELECT list_transform(range(len(embedding)), lambda i: (CASE WHEN i % 3 = 0 THEN 0.5 WHEN i % 3 = 1 THEN -0.25 ELSE 0.125 END)::DOUBLE) AS v FROM embeddings LIMIT 1),
sims AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], v) AS similarity FROM embeddings, q),
top AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank_no FROM sims)"""


def _probe(a: Archive) -> list[float]:
    size = len(a.parquet("embeddings").select("embedding").first()[0])
    return [(0.5, -0.25, 0.125)[i % 3] for i in range(size)]


def _vectors(a: Archive):
    return a.parquet("embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _nearest(a: Archive, k: int = 50):
    return se.vector_topk(_vectors(a), _probe(a), k)


query(
    "k05_vector_topk",
    "",
    f"WITH {_COS.lstrip(', ')} SELECT id, round(similarity, 9) AS similarity FROM top WHERE rank_no <= 50",
)(lambda a: _nearest(a).select("id", F.round("similarity", 9).alias("similarity")))

query(
    "k05_rrf",
    "texts",
    f"""{_RANK}{_COS}, words AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS rank_no FROM rank)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank_no)), 9) AS rrf_score FROM (SELECT id, rank_no FROM top UNION ALL SELECT id, rank_no FROM words) GROUP BY 1""",
)(lambda a: _fused(a))


def _fused(a: Archive):
    by_vector = se.numbered(se.similarities(_vectors(a), _probe(a)), [F.desc("similarity"), F.asc("id")])
    by_words = se.numbered(se.cover_rank(_index(a), RANKED, english=False), [F.desc("rank"), F.asc("id")])
    fused = se.reciprocal_rank_fusion([by_vector, by_words])
    return fused.select("id", F.round("rrf_score", 9).alias("rrf_score"))
