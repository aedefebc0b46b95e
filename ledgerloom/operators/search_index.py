"""The stored search index: words and name trigrams by tenant, kept up with edits.

Tables of a catalog (all by tenant):

* ``words`` (lexeme, id, positions), in spans of lexemes, sorted by lexeme: a query opens its tenant's spans only,
  and inside them only row groups whose least and greatest lexeme can hold its words;
* ``names`` (trigram, id), sorted by trigram;
* ``texts`` (id, text), in slots of ids: only the slots of a result page are opened;
* ``new_words``, ``new_names``, ``edits`` (id, removed), by version: what edits since the last merge have added,
  and the documents whose older rows no longer count.

An edit writes one version: the words of the edited documents as they are now.  A repeated version overwrites
itself.  ``merge`` rewrites the spans that hold an edited document and then moves the merged version on; if it
breaks off in between, the edits still cover what was rewritten, so it can be run again.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..sources.catalog import TENANT, Catalog, Scope
from . import search as se
from .filters import PAGE_SIZE, page, relative_date, sort_columns

SPANS, SLOTS = 16, 256
#: Most bits that tell which documents a merge may touch; 16 for each edited document as long as that is less.
EDIT_BITS = 1 << 25
#: Tenant under which the index keeps its own state.
_OWN = "-"


def span_bounds(lexemes: DataFrame, spans: int = SPANS) -> list[str]:
    """Least lexeme of each span but the first, so that spans hold about equally many rows.

    Lexemes are counted by their first two characters: as many groups as there are pairs of letters.
    """
    from pyspark.sql import Window

    by_start = lexemes.groupBy(F.substring("lexeme", 1, 2).alias("start")).agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("start")
    laid = by_start.select("start", F.sum("n").over(so_far).alias("upto"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    span = F.floor((F.col("upto") - 1) * spans / F.col("total"))
    # At most one row per span.
    return sorted(r["start"] for r in laid.groupBy(span.alias("span")).agg(F.min("start").alias("start")).where("span > 0").collect())


@dataclass
class SearchIndex:
    """A catalog with the index tables, and the bounds of the spans."""

    catalog: Catalog
    bounds: list[str]
    english: bool = True
    slots: int = SLOTS

    # -- building ---------------------------------------------------------------------

    @classmethod
    def build(cls, catalog: Catalog, docs: DataFrame, english: bool = True, spans: int = SPANS, slots: int = SLOTS) -> SearchIndex:
        """Index docs(tenant_id, id, title, original_filename, text, ...) and store the documents too."""
        spark = catalog.spark
        listed = docs.drop("text")
        catalog.create("documents", listed, order=("id",))
        # Written once: laying rows out by range reads them twice.
        words = materialise(spark, se.lexeme_table(docs, english, (TENANT, "id")), "lexemes")
        index = cls(catalog, span_bounds(words, spans), english, slots)
        catalog.create("texts", docs.select(TENANT, "id", "text", index._slot().alias("slot")), by=("slot",), order=("id",))
        catalog.create("words", index._spanned(words), by=("span",), order=("lexeme", "id"))
        catalog.create("names", _names(listed), order=("trigram", "id"))
        version = F.lit(None).cast("bigint").alias("version")
        catalog.create("new_words", catalog.system("words").limit(0).select("*", version), by=("version", "span"))
        catalog.create("new_names", catalog.system("names").limit(0).select("*", version), by=("version",))
        catalog.create("edits", listed.limit(0).select("id", F.lit(False).alias("removed"), TENANT, version), by=("version",))
        catalog.create("state", index._state(0))
        return index

    @classmethod
    def open(cls, catalog: Catalog) -> SearchIndex:
        """The index that an earlier job has stored."""
        state = catalog.system("state").orderBy(F.desc("merged")).first()
        return cls(catalog, list(state["bounds"]), state["english"], state["slots"])

    def _state(self, merged: int) -> DataFrame:
        bounds = F.array(*map(F.lit, self.bounds)).cast("array<string>").alias("bounds")
        return self.catalog.spark.range(1).select(F.lit(merged).cast("bigint").alias("merged"), F.lit(self.english).alias("english"), F.lit(self.slots).alias("slots"), bounds, F.lit(_OWN).alias(TENANT))

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.slots)).cast("int")

    def _span_of(self, lexeme: Column) -> Column:
        bounds = F.array(*map(F.lit, self.bounds)).cast("array<string>")
        return F.size(F.filter(bounds, lambda b: b <= lexeme)).cast("int")

    def _spanned(self, postings: DataFrame) -> DataFrame:
        return postings.withColumn("span", self._span_of(F.col("lexeme")))

    def _spans(self, exact: list[str], prefixes: list[str]) -> list[int]:
        """Spans that can hold the words or words with the beginnings (code points order like UTF-8 bytes)."""
        found = {sum(b <= w for b in self.bounds) for w in exact}
        for p in prefixes:
            low, high = sum(b <= p for b in self.bounds), sum(b <= p or b.startswith(p) for b in self.bounds)
            found |= set(range(low, high + 1))
        return sorted(found)

    # -- reading ----------------------------------------------------------------------

    def merged(self) -> Column:
        """Version up to which edits are part of the base tables."""
        return F.lit(self.catalog.system("state").agg(F.max("merged")).first()[0])

    def _current(self, base: DataFrame, new: DataFrame, edits: DataFrame) -> DataFrame:
        """Base rows of documents without open edits, and the rows of each document's last version."""
        open_edits = edits.where(F.col("version") > self.merged())
        last = open_edits.groupBy(TENANT, "id").agg(F.max("version").alias("version"))
        kept = base.join(last.select(TENANT, "id"), [TENANT, "id"], "left_anti")
        added = new.join(last, [TENANT, "id", "version"], "left_semi").drop("version")
        return kept.unionByName(added)

    def words(self, tenant: str | None, q: str) -> DataFrame:
        """The tenant's rows (id, lexeme, positions) of the query's words and beginnings."""
        exact, prefixes = se._lexemes(se.websearch_query(q, self.english)), se.prefix_query(q, self.english)
        wanted = F.lit(False)
        if exact:
            wanted = wanted | F.col("lexeme").isin(*exact)
        for p in prefixes:
            wanted = wanted | F.col("lexeme").startswith(p)
        spans = self._spans(exact, prefixes)
        wanted = wanted & (F.col("span").isin(*spans) if spans else F.lit(False))
        return self._rows(tenant, "words", wanted).select("id", "lexeme", "positions")

    def current_words(self, wanted: Column) -> DataFrame:
        """All tenants' rows with ``wanted`` words, for upkeep jobs."""
        catalog = self.catalog
        rows = self._current(catalog.system("words").where(wanted), catalog.system("new_words").where(wanted), catalog.system("edits"))
        return rows.select(TENANT, "id", "lexeme", "positions")

    def names(self, tenant: str | None, q: str) -> DataFrame:
        """The tenant's rows (id, trigram) of the query's trigrams."""
        wanted = sorted(set(se.trigrams(q)))
        return self._rows(tenant, "names", F.col("trigram").isin(*wanted) if wanted else F.lit(False)).select("id", "trigram")

    def _rows(self, tenant: str | None, name: str, wanted: Column) -> DataFrame:
        scope = self.catalog.scope(tenant)
        return self._current(scope.table(name).where(wanted), scope.table(f"new_{name}").where(wanted), scope.table("edits"))

    def documents(self, tenant: str | None) -> DataFrame:
        return self.catalog.scope(tenant).table("documents")

    def search(
        self,
        tenant: str | None,
        q: str,
        document_type: str | None = None,
        window: str | None = None,
        status: str | None = None,
        number: int = 1,
        size: int = PAGE_SIZE,
        as_of: datetime.datetime | None = None,
        documents: DataFrame | None = None,
    ) -> DataFrame:
        """One page of a tenant's results, best first, with snippets.

        ``documents`` are the tenant's documents as they are now, if edits have been made since the index was built.
        """
        docs = self.documents(tenant) if documents is None else documents.where(self.catalog.scope(tenant).mine).drop("text")
        if document_type:
            docs = docs.filter(F.col("document_type") == document_type)
        if status:
            docs = docs.filter(F.col("status") == status)
        if window:
            docs = relative_date(docs, window, as_of or datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        hits = se.search_hits(docs, self.words(tenant, q), q, self.english, self.names(tenant, q))
        top = page(hits, sort_columns(None, ranked=True), number, size).withColumn("slot", self._slot())
        # The page is a few rows: its slots prune the texts when the join runs.
        texts = self.catalog.scope(tenant).table("texts").select("slot", "id", "text")
        shown = texts.join(F.broadcast(top), ["slot", "id"], "right")
        marked = shown.withColumn("snippet", se.snippet(q, F.col("text"), F.col("content_match"), self.english))
        return marked.drop("text", "slot").orderBy(*sort_columns(None, ranked=True))

    # -- upkeep -----------------------------------------------------------------------

    def apply(self, version: int, edited: DataFrame, removed: DataFrame | None = None) -> None:
        """Write one version of edits: documents as they are now (with text), and removed ones (tenant_id, id).

        Versions are numbered upwards from 1; running one again replaces it.
        """
        number = F.lit(version).cast("bigint").alias("version")
        ids = edited.select(TENANT, "id", F.lit(False).alias("removed"), number)
        if removed is not None:
            ids = ids.unionByName(removed.select(TENANT, "id", F.lit(True).alias("removed"), number))
        words = self._spanned(materialise(self.catalog.spark, se.lexeme_table(edited, self.english, (TENANT, "id")), "lexemes"))
        # The edits come last: until they are there, readers see neither the new rows nor a gap.
        self._version("new_words", words.withColumn("version", number), ("version", "span"), version)
        self._version("new_names", _names(edited).withColumn("version", number), ("version",), version)
        self._version("edits", ids, ("version",), version)

    def _version(self, name: str, rows: DataFrame, by: tuple[str, ...], version: int) -> None:
        # Partitions of the version that the repeated run no longer has would stay: none can, as its input is the same.
        self.catalog.replace_partitions(name, rows, by)

    def merge(self, upto: int) -> DataFrame:
        """Make versions up to ``upto`` part of the base tables; returns the rewritten (tenant_id, span)."""
        spark, catalog = self.catalog.spark, self.catalog
        edits = catalog.system("edits").where((F.col("version") > self.merged()) & (F.col("version") <= upto))
        last = materialise(spark, edits.groupBy(TENANT, "id").agg(F.max("version").alias("version")), "edits")
        bits = _bits_for(last)
        spots = materialise(spark, _spots(last, bits), "edit-bits") if bits else None
        touched = None
        for name, keys in (("words", (TENANT, "span")), ("names", (TENANT,))):
            base, new = catalog.system(name), catalog.system(f"new_{name}")
            # Only rows whose bit is set meet the edits by id; the others stay where they lie until they are laid out.
            sure, doubtful = _by_bit(base, spots, bits) if bits else (base.limit(0), base)
            met = doubtful.join(last.select(TENANT, "id", F.lit(True).alias("gone")), [TENANT, "id"], "left")
            met = materialise(spark, met, f"doubtful-{name}")
            added = new.join(last, [TENANT, "id", "version"], "left_semi").drop("version")
            ranges = materialise(spark, met.where("gone").select(*keys).unionByName(added.select(*keys)).distinct(), f"touched-{name}")
            kept = sure.unionByName(met.where("gone IS NULL").drop("gone")).join(ranges, list(keys), "left_semi")
            whole = kept.where("id IS NOT NULL").unionByName(added)
            # A range whose last row went away keeps one void row, as an empty partition cannot be overwritten.
            lost = met.where("gone").groupBy(*keys).agg(F.count("*").alias("lost"))
            there = base.where("id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("there"))
            emptied = lost.join(there, list(keys)).where("lost = there").select(*keys)
            left = materialise(spark, emptied.join(added.select(*keys), list(keys), "left_anti"), f"left-{name}")
            void = left.select(*[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in whole.schema])
            catalog.replace_partitions(name, whole.unionByName(void), keys[1:], ("lexeme", "id") if name == "words" else ("trigram", "id"))
            touched = ranges if touched is None else touched
        catalog.scope(_OWN).append("state", self._state(upto))
        return touched


def _bits_for(docs: DataFrame) -> int:
    """How many bits to keep for so many documents: a power of two that Spark will broadcast; 0 if it would say too little."""
    most = 4 * docs.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    n = docs.count()
    bits = min(EDIT_BITS, 1 << (16 * max(n, 1)).bit_length(), 1 << max(0, most.bit_length() - 1) if most > 0 else 0)
    return bits if bits >= max(64, n) else 0


def _spot(bits: int) -> Column:
    return F.pmod(F.xxhash64(TENANT, "id"), F.lit(bits))


def _word(bits: int) -> Column:
    return F.shiftright(_spot(bits), 6).cast("int").alias("word")


def _spots(docs: DataFrame, bits: int) -> DataFrame:
    """The documents' bits, in words of 64: (word, flags), small enough to be joined to rows where they lie."""
    spot = docs.select(_word(bits), (_spot(bits) % 64).cast("int").alias("bit"))
    return spot.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("flags"))


def _by_bit(rows: DataFrame, spots: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows that belong to none of the documents of ``spots``, and rows that may."""
    flagged = rows.withColumn("word", _word(bits)).join(spots, "word", "left")
    may = F.coalesce(F.getbit("flags", (_spot(bits) % 64).cast("int")), F.lit(0)) == 1
    return flagged.where(~may).select(*rows.columns), flagged.where(may).select(*rows.columns)


def _names(docs: DataFrame) -> DataFrame:
    """(tenant_id, id, trigram) of the titles and file names."""
    both = F.concat(se.trigram_column(F.coalesce("title", "original_filename")), se.trigram_column(F.col("original_filename")))
    return docs.select(TENANT, "id", F.explode(F.array_distinct(both)).alias("trigram"))
