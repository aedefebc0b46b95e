"""Text search: word index, query matching, name similarity, ranking and snippets.

The word index is a table (id, lexeme, positions) written once when documents
change.  A query reads only the rows of its own words: equality and prefix filters
on ``lexeme`` reach the Parquet scan, and everything after works on those rows.
"""

from __future__ import annotations

import datetime
import html
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from ..functions.binding import bind
from ..functions.stem import STOP_WORDS, stem
from ..session import materialise
from .filters import PAGE_SIZE, live, page, relative_date, sort_columns

WORD = r"[\p{L}\p{N}]+"
NAME_THRESHOLD = 0.2
# Weight of an unlabelled word in the cover rank.
WORD_WEIGHT = 0.1


# -- index ------------------------------------------------------------------------


def search_text(title: Column, filename: Column, text: Column) -> Column:
    """Title, file name and text that are not empty, joined by blanks."""
    filled = [F.when(c != "", c) for c in (title, filename, text)]
    return F.concat_ws(" ", *filled)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def normal_form(word: str, english: bool = True) -> str | None:
    """Index form of a lower-case word; NULL for a stop word."""
    if not english:
        return word
    return None if word in STOP_WORDS else stem(word)


@arrow_udf(T.ArrayType(T.StringType()))
def _normal_forms(lists: pa.Array) -> pa.Array:
    """Index form of every word of the lists; each distinct word of a batch is stemmed once."""
    coded = pc.dictionary_encode(lists.flatten())
    forms = pa.array([normal_form(w) for w in coded.dictionary.to_pylist()], pa.string())
    kept = forms.take(coded.indices)
    return pa.ListArray.from_arrays(_offsets(lists), kept)


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def lexeme_table(docs: DataFrame, english: bool = True, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, lexeme, positions) of docs(id, title, original_filename, text).

    Stop words count as positions but are not indexed.  Only the texts are shuffled, so that rows of one key meet;
    the words of a document are sorted and gathered inside its row.
    """
    body = search_text(F.col("title"), F.col("original_filename"), F.col("text"))
    whole = docs.groupBy(*keys).agg(F.collect_list(body).alias("bodies"))
    # One-row generators: every step is computed once per document.
    found = whole.select(*keys, F.explode(F.array(F.transform("bodies", _placed))).alias("placed")).select(*keys, F.flatten("placed").alias("words"))
    if english:
        forms = found.withColumn("forms", _normal_forms(F.transform("words", lambda w: w["lexeme"])))
        stemmed = F.zip_with("forms", "words", lambda f, w: F.struct(f.alias("lexeme"), w["position"].alias("position")))
        found = forms.select(*keys, F.filter(stemmed, lambda w: w["lexeme"].isNotNull()).alias("words"))
    return found.select(*keys, F.inline(bind(F.sort_array("words"), _gathered)))


def _placed(body: Column) -> Column:
    return F.transform(words(body), lambda w, i: F.struct(w.alias("lexeme"), (i + 1).alias("position")))


def _gathered(placed: Column) -> Column:
    """Structs of a word and its positions, from sorted structs of a word and one position."""
    size = F.size(placed)
    new_word = lambda i: (i == 0) | (F.get(placed, i)["lexeme"] != F.get(placed, i - 1)["lexeme"])
    starts = F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), new_word))

    def gather(starts: Column) -> Column:
        def of_word(start: Column, n: Column) -> Column:
            run = F.slice(placed, start + 1, F.coalesce(F.get(starts, n + 1), size) - start)
            return F.struct(F.get(placed, start)["lexeme"].alias("lexeme"), F.transform(run, lambda w: w["position"]).alias("positions"))

        return F.transform(starts, of_word)

    return bind(starts, gather)


# -- queries ------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """Words at fixed distances; one word unless quoted."""

    lexemes: tuple[str, ...]
    offsets: tuple[int, ...]
    negated: bool = False


def _term(text: str, negated: bool, english: bool) -> Term | None:
    forms = [(i, normal_form(w, english)) for i, w in enumerate(re.findall(r"[^\W_]+", text.lower()))]
    kept = [(i, f) for i, f in forms if f is not None]
    if not kept:
        return None
    return Term(tuple(f for _, f in kept), tuple(i - kept[0][0] for i, _ in kept), negated)


def websearch_query(q: str, english: bool = True) -> list[list[Term]]:
    """Alternatives of conjunctions: words, "phrases", ``or`` and ``-excluded``."""
    groups: list[list[Term]] = [[]]
    for match in re.finditer(r'(-?)"([^"]*)"?|(\S+)', q):
        dash, quoted, bare = match.group(1), match.group(2), match.group(3)
        if bare is not None and bare.lower() == "or":
            groups.append([])
            continue
        negated = dash == "-" if bare is None else bare.startswith("-")
        term = _term(quoted if bare is None else bare, negated, english)
        if term is not None:
            groups[-1].append(term)
    return [g for g in groups if g]


def prefix_query(q: str, english: bool = True) -> list[str]:
    """Word beginnings that must all occur; empty when there is none to look for."""
    tokens = [t.lower() for t in re.split(r"[^a-zA-Z0-9]", q) if len(t) >= 2]
    return [f for f in (normal_form(t, english) for t in tokens) if f]


def _lexemes(groups: list[list[Term]]) -> list[str]:
    return sorted({w for g in groups for t in g for w in t.lexemes})


def content_flags(index: DataFrame, q: str, english: bool = True) -> DataFrame:
    """Per document of the index that holds any query word: ``by_words``, ``by_prefix``.

    One filtered scan and one aggregation by document; documents that hold none of
    the words are not in the result (see ``content_match``).
    """
    groups, prefixes = websearch_query(q, english), prefix_query(q, english)
    exact = _lexemes(groups)
    wanted = F.lit(False)
    if exact:
        wanted = wanted | F.col("lexeme").isin(*exact)
    for prefix in prefixes:
        wanted = wanted | F.col("lexeme").startswith(prefix)
    # Positions are carried only for words of a phrase; a flag is enough for others.
    in_phrase = {w for g in groups for t in g if len(t.lexemes) > 1 for w in t.lexemes}
    columns = [
        F.max(F.when(F.col("lexeme") == w, F.col("positions") if w in in_phrase else F.lit(True))).alias(f"p{i}")
        for i, w in enumerate(exact)
    ]
    starts = [F.max(F.col("lexeme").startswith(p)).alias(f"s{i}") for i, p in enumerate(prefixes)]
    if not columns and not starts:
        return index.filter(F.lit(False)).select("id", F.lit(False).alias("by_words"), F.lit(False).alias("by_prefix"))
    found = index.filter(wanted).groupBy("id").agg(*columns, *starts)
    slot = {w: F.col(f"p{i}") for i, w in enumerate(exact)}
    by_prefix = F.lit(bool(prefixes))
    for i in range(len(prefixes)):
        by_prefix = by_prefix & F.col(f"s{i}")
    return found.select("id", _words_match(groups, slot).alias("by_words"), by_prefix.alias("by_prefix"))


def _words_match(groups: list[list[Term]], slot: dict[str, Column]) -> Column:
    def holds(term: Term) -> Column:
        first = slot[term.lexemes[0]]
        if len(term.lexemes) == 1:
            hit = first.isNotNull()
        else:
            def at(x: Column) -> Column:
                rest = [F.array_contains(slot[w], x + F.lit(d)) for w, d in zip(term.lexemes[1:], term.offsets[1:])]
                return _all(rest)

            hit = F.coalesce(F.exists(first, at), F.lit(False))
        return ~hit if term.negated else hit

    out = F.lit(False)
    for group in groups:
        out = out | _all([holds(t) for t in group])
    return out


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def matches_without_words(q: str, english: bool = True) -> bool:
    """Can a document without any query word match (only exclusions in a group)?"""
    return any(all(t.negated for t in g) for g in websearch_query(q, english))


def content_match(docs: DataFrame, index: DataFrame, q: str, english: bool = True) -> DataFrame:
    """Add ``content_match`` to docs: query words or all word beginnings."""
    flags = content_flags(index, q, english).select("id", (F.col("by_words") | F.col("by_prefix")).alias("content_match"))
    absent = F.lit(matches_without_words(q, english))
    return docs.join(flags, "id", "left").withColumn("content_match", F.coalesce("content_match", absent))


# -- names ------------------------------------------------------------------------------


def trigrams(text: str) -> list[str]:
    """Ordered trigrams of a text's words, each padded two blanks left and one right."""
    out = []
    for word in re.findall(r"[^\W_]+", text.lower()):
        padded = f"  {word} "
        out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return out


def trigram_column(name: Column) -> Column:
    # The words, padded and apart by line ends, are read by one pattern: runs of three that cross no line end.
    apart = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " \n  ")
    return F.regexp_extract_all(F.concat(F.lit("  "), apart, F.lit(" ")), F.lit(r"(?=(?!   )([^\n]{3}))(?s:.)"), 1)


def word_similarity(q: str, name: Column) -> Column:
    """Best overlap of the query's trigrams with any run of the name's trigrams.

    Overlap is shared trigrams over all distinct trigrams of query and run.  A best
    run begins and ends with a shared trigram, so only those are tried.
    """
    wanted = sorted(set(trigrams(q)))
    if not wanted:
        return F.lit(0.0)
    query = F.array(*[F.lit(t) for t in wanted])

    def best(grams: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(query, F.get(grams, i - 1)))

        def score(a: Column, b: Column) -> Column:
            run = F.array_distinct(F.slice(grams, a, b - a + 1))
            shared = F.size(F.array_intersect(run, query))
            return shared / (F.size(run) + F.lit(len(wanted)) - shared)

        pairs = F.transform(spots, lambda a: F.array_max(F.transform(F.filter(spots, lambda b: b >= a), lambda b: score(a, b))))
        return F.when(F.size(grams) > 0, F.array_max(pairs))

    # Nothing shared is the common case and skips the search for runs.
    scores = F.transform(
        F.array(trigram_column(name)), lambda g: F.when(F.arrays_overlap(g, query), best(g)).otherwise(F.lit(0.0))
    )
    return F.coalesce(F.get(scores, 0), F.lit(0.0))


def name_similarity(q: str) -> Column:
    """Better of the similarities with the title (else the file name) and the file name."""
    title = F.coalesce("title", "original_filename")
    return F.greatest(word_similarity(q, title), word_similarity(q, F.col("original_filename")))


def trigram_table(docs: DataFrame) -> DataFrame:
    """(id, trigram) of the titles and file names, written once like the word index."""
    both = F.concat(
        trigram_column(F.coalesce("title", "original_filename")), trigram_column(F.col("original_filename"))
    )
    return docs.select("id", F.explode(F.array_distinct(both)).alias("trigram"))


def name_candidates(name_index: DataFrame, q: str) -> DataFrame:
    """Ids whose names can reach the threshold.

    A similarity of t needs at least t times the query's trigrams to be shared, so
    leaving out names that share fewer loses no match.
    """
    wanted = sorted(set(trigrams(q)))
    shared = name_index.filter(F.col("trigram").isin(*wanted) if wanted else F.lit(False))
    enough = F.col("n") >= NAME_THRESHOLD * len(wanted) - 1e-9
    return shared.groupBy("id").agg(F.count("*").alias("n")).filter(enough).select("id")


# -- ranking ------------------------------------------------------------------------------


def cover_rank(index: DataFrame, q: str, english: bool = True) -> DataFrame:
    """Rank per document from the smallest runs of words that satisfy the query.

    A run satisfies it if all words of one alternative are inside; each smallest run adds its weight, divided
    by one plus the other words inside it.  One pass over the rows of the query's words, by document and
    position: the latest run that ends at a row begins at the latest of the alternatives' beginnings, and it is
    smallest if no earlier row has the same beginning.  Words of a phrase count like single words; excluded
    words do not count.
    """
    groups = [sorted({w for t in g if not t.negated for w in t.lexemes}) for g in websearch_query(q, english)]
    groups = [g for g in groups if g]
    if not groups:
        return index.filter(F.lit(False)).select("id", F.lit(0.0).alias("rank"))
    used = sorted({w for g in groups for w in g})
    rows = index.filter(F.col("lexeme").isin(*used)).select("id", "lexeme", F.explode("positions").alias("pos"))
    by_doc = Window.partitionBy("id").orderBy("pos")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("n", F.row_number().over(by_doc))
    latest = [F.max(F.when(F.col("lexeme") == w, F.struct("pos", "n"))).over(so_far).alias(f"l{i}") for i, w in enumerate(used)]
    ends = numbered.select("id", "pos", "n", *latest)

    def begin(group: list[str]) -> Column:
        slots = [F.col(f"l{used.index(w)}") for w in group]
        return slots[0] if len(slots) == 1 else F.when(_all([c.isNotNull() for c in slots]), F.least(*slots))

    begins = [begin(g) for g in groups]
    latest_begin = begins[0] if len(begins) == 1 else F.greatest(*begins)
    runs = ends.withColumn("begin", latest_begin).filter("begin IS NOT NULL").groupBy("id", "begin").agg(F.min(F.struct("pos", "n")).alias("end"))
    inside = F.col("end.n") - F.col("begin.n")
    gap = F.col("end.pos") - F.col("begin.pos") - inside
    # Whole billionths: the sum does not depend on the order of the additions.
    weight = F.round(F.lit(WORD_WEIGHT) / (1 + gap) * 1e9).cast("bigint")
    return runs.groupBy("id").agg((F.sum(weight) / 1e9).alias("rank"))


# -- snippets -------------------------------------------------------------------------------

MAX_FRAGMENTS, MIN_WORDS, MAX_WORDS = 2, 5, 24


def _fragment_text(text: str, hit) -> str | None:
    """Up to two fragments around matching words: escaped, the words in mark tags."""
    shown_as = lambda part: html.escape(part, quote=False)
    tokens = [(m.start(), m.end(), hit(m.group().lower())) for m in re.finditer(r"[^\W_]+", text)]
    hits = [i for i, t in enumerate(tokens) if t[2]]
    if not hits:
        last = min(len(tokens), MIN_WORDS)
        return shown_as(text[: tokens[last - 1][1]] if tokens else text)
    fragments: list[tuple[int, int]] = []
    for i in hits:
        if fragments and i <= fragments[-1][1]:
            continue
        if len(fragments) == MAX_FRAGMENTS:
            break
        # Grow to the last hit within reach, then to the least number of words.
        end = max(j for j in hits if i <= j < i + MAX_WORDS)
        begin = i
        while end - begin + 1 < MIN_WORDS and (end + 1 < len(tokens) or begin > 0):
            if end + 1 < len(tokens):
                end += 1
            elif not fragments or begin - 1 > fragments[-1][1]:
                begin -= 1
            else:
                break
        fragments.append((begin, end))
    shown = []
    for begin, end in fragments:
        out, at = [], tokens[begin][0]
        for start, stop, is_hit in tokens[begin : end + 1]:
            word = shown_as(text[start:stop])
            out += [shown_as(text[at:start]), f"<mark>{word}</mark>" if is_hit else word]
            at = stop
        shown.append("".join(out))
    return " ... ".join(shown)


def snippet(q: str, text: Column, matched: Column, english: bool = True) -> Column:
    """Marked fragments of matching texts; meant for the rows of one page."""
    prefixes = tuple(prefix_query(q, english))
    exact = frozenset(_lexemes(websearch_query(q, english)))

    def hit(word: str) -> bool:
        form = normal_form(word, english)
        return form is not None and (form.startswith(prefixes) if prefixes else form in exact)

    @pandas_udf(T.StringType())
    def fragments(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _fragment_text(t, hit))

    return fragments(F.when(matched, text))


# -- search ------------------------------------------------------------------------------------


def search_hits(
    docs: DataFrame, index: DataFrame, q: str, english: bool = True, name_index: DataFrame | None = None
) -> DataFrame:
    """Live documents that match by content or by name, with flags and score.

    docs: id, title, original_filename, uploaded_at, deleted_at and others.  A
    blank query matches nothing.  With ``name_index`` (see ``trigram_table``) only
    documents that the two indexes point to are looked at; without it every name
    is compared.
    """
    term = (q or "").strip()
    if not term:
        empty = live(docs).filter(F.lit(False))
        return empty.withColumns(
            {"content_match": F.lit(False), "name_score": F.lit(0.0), "score": F.lit(0.0), "matched_fields": F.array().cast("array<string>")}
        )
    if name_index is None or matches_without_words(term, english):
        flagged = content_match(live(docs), index, term, english)
    else:
        flags = content_flags(index, term, english).filter("by_words OR by_prefix")
        found = flags.select("id", F.lit(True).alias("content_match"))
        either = found.join(name_candidates(name_index, term), "id", "full_outer")
        flagged = live(docs).join(either, "id").withColumn("content_match", F.coalesce("content_match", F.lit(False)))
    # A one-row generator: the similarity is computed once per document.
    scored = flagged.select("*", F.explode(F.array(name_similarity(term))).alias("name_score"))
    by_name = F.col("name_score") >= NAME_THRESHOLD
    hits = scored.filter(F.col("content_match") | by_name)
    ranked = hits.join(cover_rank(index, term, english), "id", "left")
    fields = F.filter(
        F.array(F.when(F.col("content_match"), F.lit("content")), F.when(by_name, F.lit("filename"))), lambda f: f.isNotNull()
    )
    return ranked.withColumns(
        {"score": F.coalesce("rank", F.lit(0.0)) + F.col("name_score"), "matched_fields": fields}
    ).drop("rank")


def search(
    docs: DataFrame,
    index: DataFrame,
    q: str,
    document_type: str | None = None,
    window: str | None = None,
    status: str | None = None,
    number: int = 1,
    size: int = PAGE_SIZE,
    as_of: datetime.datetime | None = None,
    english: bool = True,
    name_index: DataFrame | None = None,
) -> DataFrame:
    """One page of results, best first, with snippets.

    The cheap filters run before the match; snippets are cut only for the page.
    """
    if document_type:
        docs = docs.filter(F.col("document_type") == document_type)
    if status:
        docs = docs.filter(F.col("status") == status)
    if window:
        docs = relative_date(docs, window, as_of or datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
    text = docs.select("id", "text")
    hits = search_hits(docs.drop("text"), index, q, english, name_index)
    top = page(hits, sort_columns(None, ranked=True), number, size)
    shown = top.join(text, "id")
    return (
        shown.withColumn("snippet", snippet(q, F.col("text"), F.col("content_match"), english))
        .drop("text")
        .orderBy(*sort_columns(None, ranked=True))
    )


# -- vectors ---------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, in doubles."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, r: p.cast("double") * r.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def similarities(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Every vector with its cosine."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("id", cosine(F.col("embedding"), target).alias("similarity"))


def vector_topk(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest vectors by cosine; each task keeps its own k best."""
    return similarities(vectors, query).orderBy(F.desc("similarity"), F.asc("id")).limit(k)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Fused score of ranked lists (id, rank_no): the sum of 1 / (k + rank)."""
    parts = [r.select("id", (1.0 / (F.lit(k) + F.col("rank_no"))).alias("part")) for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy("id").agg(F.sum("part").alias("rrf_score"))


def numbered(ranking: DataFrame, order: list[Column]) -> DataFrame:
    """Rank numbers for a list of any length.

    Rows are dealt by range of the order, which must be total, and numbered inside their block; the blocks
    before it give the offset.  The dealt rows are written once, so that counts and numbers see the same blocks.
    """
    dealt = ranking.repartitionByRange(*order).withColumn("_block", F.spark_partition_id())
    dealt = materialise(ranking.sparkSession, dealt, "ranking")
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_block").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(offsets, "_block").select(
        *ranking.columns, (F.col("_before") + F.col("_inside")).alias("rank_no")
    )
