"""Model answers: tolerant parsing, structure, validation and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonvalues as jv
from ..functions.pyjson import json_nodes, member, merge_objects, nest_paths, repair_json

# Document types a model may answer with.
MODEL_TYPES = ("invoice", "receipt", "contract", "report", "letter", "form", "other")
# Parts of key names whose last value wins in a merge.
TOTAL_KEYS = ("total", "amount_due", "grand_total", "balance_due", "amount_payable")


def total_like(key: Column) -> Column:
    return F.lower(key).rlike("|".join(TOTAL_KEYS))


# -- parsing -----------------------------------------------------------------------


def parse_model_output(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (JSON object text or NULL), ``model_type``, ``confidence``, ``fields``.

    Fences are stripped, then the whole answer, its largest braced span and a
    repaired version are tried in turn.  Only answers that the first two steps
    cannot read are handed to the Python repair.
    """
    text = F.btrim(F.col(raw), F.lit(jv.BLANKS))
    bare = F.btrim(F.regexp_replace(F.regexp_replace(text, r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", ""), F.lit(jv.BLANKS))

    def readable(c: Column) -> Column:
        # The reader stops after one value; inside brackets and inside braces it must be the only thing there.
        listed = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
        keyed = F.try_parse_json(F.concat(F.lit('{"w":'), c, F.lit("}")))
        alone = listed.isNotNull() & keyed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull()
        return F.when(alone & F.try_parse_json(c).isNotNull() & (c != ""), c)

    def first_try(t: Column) -> Column:
        first = F.coalesce(readable(t), readable(F.regexp_extract(t, r"(?s)(\{.*\})", 1)))
        return F.struct(first.alias("_first"), F.regexp_extract(t, r"(?s)(\{.*)$", 1).alias("_braced"))

    def answer(obj: Column) -> Column:
        wrapped = jv.is_object(jv.key(obj, "fields"))
        flat = F.map_filter(obj, lambda k, v: ~F.lower(k).isin("documenttype", "document_type", "confidence"))
        fields = F.when(wrapped, jv.members(jv.key(obj, "fields"))).otherwise(flat)
        # An unwrapped answer may use either spelling of the type key.
        named = F.when(wrapped, jv.key(obj, "documentType")).otherwise(
            F.coalesce(jv.key(obj, "documentType"), jv.key(obj, "document_type"))
        )
        confidence = jv.key(obj, "confidence")
        # A type or confidence of the wrong JSON type makes the whole answer unusable.
        valid = (named.isNull() | jv.is_string(named)) & (confidence.isNull() | jv.number_of(confidence).isNotNull())
        kind = F.lower(F.coalesce(jv.text_of(named), F.lit("other")))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(jv.number_of(confidence), F.lit(0.0))))
        result = F.struct(
            F.to_json(obj).alias("parsed"),
            F.when(kind.isin(*MODEL_TYPES), kind).otherwise("other").alias("model_type"),
            clamped.alias("confidence"),
            fields.alias("fields"),
        )
        return F.when(obj.isNotNull() & F.coalesce(valid, F.lit(False)), result)

    # One-row generators keep later filters from copying these expressions.
    tried = df.select(
        "*", F.inline_outer(F.transform(F.array(F.when(text.startswith("```"), bare).otherwise(text)), first_try))
    )
    broken = F.when(F.col("_first").isNull() & (F.col("_braced") != ""), F.col("_braced"))
    fixed = tried.withColumn("_fixed", repair_json(broken))
    obj = jv.as_object(F.coalesce("_first", readable(F.col("_fixed"))))
    return fixed.select("*", F.inline_outer(F.transform(F.array(obj), answer))).drop("_first", "_braced", "_fixed")


# -- merging chunk answers ------------------------------------------------------------


def _empty(value: Column) -> Column:
    return F.to_json(value).isin("null", '""', "[]", "{}")


def _fold(values: Column, key: Column) -> Column:
    """Merge one key's values in chunk order."""
    none = F.lit(None).cast("variant")
    start = F.struct(F.lit(False).alias("is_list"), F.array().cast(jv.LIST).alias("items"), none.alias("scalar"))

    def step(acc: Column, entry: Column) -> Column:
        value = entry["value"]
        held = F.when(acc["is_list"], F.size(acc["items"]) > 0).otherwise(F.coalesce(~_empty(acc["scalar"]), F.lit(False)))
        takes = ~F.coalesce(_empty(value), F.lit(True)) & (total_like(key) | ~held)
        as_list = F.struct(
            F.lit(True).alias("is_list"),
            F.when(acc["is_list"], F.concat(acc["items"], jv.elements(value))).otherwise(jv.elements(value)).alias("items"),
            none.alias("scalar"),
        )
        as_scalar = F.struct(F.lit(False).alias("is_list"), F.array().cast(jv.LIST).alias("items"), value.alias("scalar"))
        return F.when(jv.is_list(value), as_list).when(takes, as_scalar).otherwise(acc)

    def finish(acc: Column) -> Column:
        return F.when(acc["is_list"], F.to_json(acc["items"])).otherwise(F.to_json(acc["scalar"]))

    return F.aggregate(values, start, step, finish)


def merge_chunk_fields(parts: DataFrame) -> DataFrame:
    """Merged value per document and key, as JSON text.

    Input: document_id, chunk_no, fields (map).  Lists are concatenated, total-like
    keys take the last filled value, all others the first.  A document with one
    part keeps its fields as they are.
    """
    rows = parts.select("document_id", "chunk_no", F.explode("fields").alias("key", "value"))
    grouped = rows.groupBy("document_id", "key").agg(
        F.collect_list(F.struct("chunk_no", F.to_json("value").alias("text"))).alias("texts")
    )
    ordered = F.transform(
        F.array_sort("texts"), lambda e: F.struct(e["chunk_no"].alias("chunk_no"), F.parse_json(e["text"]).alias("value"))
    )
    counts = parts.groupBy("document_id").agg(F.count("*").alias("n_parts"))
    merged = grouped.join(counts, "document_id").withColumn("_values", ordered)
    single = F.get("texts", 0)["text"]
    value = F.when(F.col("n_parts") == 1, single).otherwise(_fold(F.col("_values"), F.col("key")))
    return merged.select("document_id", "key", F.explode(F.array(value)).alias("value")).filter("value IS NOT NULL")


def merge_chunk_header(parts: DataFrame) -> DataFrame:
    """Type and confidence per document over its chunks.

    The commonest type other than ``other`` wins, ties go to the one seen first.
    """
    per_type = parts.filter("model_type <> 'other'").groupBy("document_id", "model_type").agg(
        F.count("*").alias("n"), F.min("chunk_no").alias("first_seen")
    )
    winner = per_type.groupBy("document_id").agg(
        F.max_by("model_type", F.struct("n", -F.col("first_seen"))).alias("model_type")
    )
    # Decimals: the mean does not depend on the order of the additions.
    mean = F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double")
    base = parts.groupBy("document_id").agg(mean.alias("confidence"))
    return base.join(winner, "document_id", "left").withColumn("model_type", F.coalesce("model_type", F.lit("other")))


def two_phase_parts(parts: DataFrame) -> DataFrame:
    """Answers of the header call and the item calls, ready to be merged.

    Input: document_id, chunk_no, call (``header``, ``items`` or ``vision``), fields and the like.  The header
    call comes before all item calls and its line items do not count: the item calls read every chunk, the
    header's included.
    """
    header = F.col("call") == "header"
    return parts.withColumns(
        {
            "fields": F.when(header, F.map_filter("fields", lambda k, v: k != "line_items")).otherwise(F.col("fields")),
            "chunk_no": F.when(header, F.lit(-1)).otherwise(F.col("chunk_no")),
        }
    ).drop("call")


# -- merging page objects --------------------------------------------------------------


def merge_pages(pages: DataFrame) -> DataFrame:
    """Merged members per document and path, as JSON text.

    Input: document_id, page_no, data (JSON object text).  Pages are merged in
    order: lists are concatenated, objects merge member by member, total-like keys
    take the last filled value and others keep the first, whatever its kind.
    The result is one object per document, so a document's pages meet in one row.
    """
    seen = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "data"))).alias("seen"))
    merged = seen.select("document_id", merge_objects(TOTAL_KEYS, "validation_errors")(F.col("seen.data")).alias("data"))
    nodes = merged.select("document_id", F.inline(json_nodes(F.col("data"))))
    compact = F.coalesce(F.to_json(F.try_parse_json("json")), "json")
    return nodes.select("document_id", "path", F.when(F.col("kind") == "list", compact).otherwise(F.col("json")).alias("value"))


def page_errors(pages: DataFrame) -> DataFrame:
    """Distinct validation errors over a document's pages; any error asks for review.

    Input: document_id, page_no, data, error (text of a failed page or NULL).
    """
    listed = F.from_json(F.get_json_object("data", "$.validation_errors"), "array<string>")
    failed = F.when(
        F.col("error").isNotNull(),
        F.array(F.format_string("Page %d failed to process: %s", F.col("page_no"), F.col("error"))),
    )
    errors = F.explode(F.coalesce(failed, listed)).alias("error")
    rows = pages.select("document_id", errors).distinct()
    return rows.groupBy("document_id").agg(F.array_sort(F.collect_list("error")).alias("validation_errors")).withColumn(
        "requires_human_review", F.lit(True)
    )


def assemble(merged: DataFrame) -> DataFrame:
    """One JSON object text per document from its merged paths."""
    grouped = merged.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("path", "value"))).alias("m"))
    return grouped.select(
        "document_id",
        nest_paths(F.transform("m", lambda e: e["path"]), F.transform("m", lambda e: e["value"])).alias("data"),
    )


# -- structure and validation ------------------------------------------------------------

# Sections of a result without a schema.
DEFAULT_SECTIONS = (
    ("document_details", "{}"), ("vendor_details", "{}"), ("client_details", "{}"), ("line_items", "[]"), ("financials", "{}"),
)
SUBTOTAL_KEYS = ("subtotal", "sub_total")
TAX_KEYS = ("tax_amount", "tax", "vat_amount", "gst_amount")
REMOTE_TAX_KEYS = ("tax", "tax_amount", "tax_total", "vat")
GRAND_TOTAL_KEYS = ("total_amount", "grand_total", "total", "amount_due")
VENDOR_PARENTS = ("vendor_details", "invoice_metadata", "metadata", "header")
VENDOR_KEYS = ("company_name", "vendor_name")
TOLERANCE = 0.02


def ensure_structure(data: Column, schema: Column | None = None) -> Column:
    """Object text with every schema key present, plus the review flags.

    A missing key gets the empty value of its schema type; numbers and booleans
    both get 0.0.  Keys already there keep their value.
    """
    if schema is None:
        base = F.create_map(*[F.lit(x) for k, v in DEFAULT_SECTIONS for x in (k, v)])
    else:
        base = F.transform_values(
            jv.as_object(schema),
            lambda k, v: F.when(jv.is_list(v), "[]")
            .when(jv.is_object(v), "{}")
            .when(jv.is_number(v) | jv.is_boolean(v), "0.0")
            .otherwise("null"),
        )
    flags = F.create_map(
        F.lit("requires_human_review"), F.lit("false"), F.lit("validation_errors"), F.lit("[]")
    )
    defaults = F.transform_values(F.map_concat(base, flags), lambda k, v: F.parse_json(v))
    return F.to_json(F.map_concat(defaults, F.coalesce(jv.as_object(data), F.create_map().cast(jv.OBJECT))))


def validate_extraction(df: DataFrame, data: str = "data", schema: str | None = None, remote: bool = False) -> DataFrame:
    """Add ``issues``, ``requires_human_review`` and ``validation_errors``.

    The first number under a subtotal, tax and total key (depth first) must add
    up, and a vendor name must be there if the schema asks for one.  ``remote`` is
    the page server's variant: keys are compared in lower case, other tax names
    count and new issues are appended to the ones already listed.
    """
    nodes = F.col("_nodes")

    def first_number(keys: tuple[str, ...]) -> Column:
        name = (lambda n: F.lower(n["key"])) if remote else (lambda n: n["key"])
        return F.get(F.filter(nodes, lambda n: name(n).isin(*keys) & n["number"].isNotNull()), 0)["number"]

    def shown(c: Column) -> Column:
        # Plain digits up to 16 places, as the messages are fixed; Spark would change to powers of ten at 10 million.
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"0+$", ""), r"\.$", ".0")
        return F.when((F.abs(c) >= 1e7) & (F.abs(c) < 1e16), plain).otherwise(c.cast("string"))

    sub, tax, total = F.col("_sub"), F.col("_tax"), F.col("_total")
    mismatch = F.when(
        F.abs(sub + tax - total) > TOLERANCE,
        F.concat(
            F.lit("Math mismatch: Subtotal("), shown(sub), F.lit(") + Tax("), shown(tax), F.lit(") != Total("), shown(total), F.lit(")")
        ),
    )
    places = [f"/{p}/{k}" for p in VENDOR_PARENTS for k in VENDOR_KEYS] + [f"/{k}" for k in reversed(VENDOR_KEYS)]
    blank = ("null", '""', "false", "0", "0.0", "[]", "{}")
    named = F.exists(nodes, lambda n: n["path"].isin(*places) & ~n["json"].isin(*blank) & (n["kind"] != "object"))
    wants = F.lit(True)
    staged = df.withColumn("_nodes", json_nodes(F.col(data)))
    if schema is not None:
        staged = staged.withColumn("_schema_nodes", json_nodes(F.col(schema)))
        # No schema, or an empty one, asks for the vendor.
        wants = (
            F.col("_schema_nodes").isNull()
            | (F.size("_schema_nodes") == 0)
            | F.exists("_schema_nodes", lambda n: n["key"].isin(*VENDOR_KEYS))
        )
    missing = F.when(wants & ~F.coalesce(named, F.lit(False)), "Missing Vendor Name")
    listed = F.from_json(member(nodes, "/validation_errors"), "array<string>")
    flagged = F.coalesce(member(nodes, "/requires_human_review") == "true", F.lit(False))
    earlier = F.coalesce(listed, F.array().cast("array<string>"))
    bad = F.size("issues") > 0
    errors = (
        F.array_union(earlier, F.col("issues")) if remote else F.when(bad, F.col("issues")).otherwise(earlier)
    )
    tax_keys = REMOTE_TAX_KEYS if remote else TAX_KEYS
    return (
        staged.withColumns(
            {"_sub": first_number(SUBTOTAL_KEYS), "_tax": first_number(tax_keys), "_total": first_number(GRAND_TOTAL_KEYS)}
        )
        .withColumn("issues", F.filter(F.array(mismatch, missing), lambda i: i.isNotNull()))
        .withColumns({"requires_human_review": bad | flagged, "validation_errors": errors})
        .drop("_nodes", "_schema_nodes", "_sub", "_tax", "_total")
    )


# -- page text ------------------------------------------------------------------------

_TABLE = r"(?s)<table>.*?</table>"
# Named entities that table cells are decoded from.
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _cell_text(cell: Column) -> Column:
    text = F.regexp_replace(cell, r"\s*<[^>]*>\s*", "")
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def table_to_markdown(table: Column) -> Column:
    """Markdown rows of an HTML table; a table without rows stays as it is."""
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|</table>|$)"), 1)

    def cells(row: Column) -> Column:
        found = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|$)"), 1)
        return F.transform(found, _cell_text)

    def line(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))

    def with_rule(row: Column, i: Column) -> Column:
        values = cells(row)
        rule = line(F.transform(values, lambda _: F.lit("---")))
        return F.when(i == 0, F.concat(line(values), F.lit("\n"), rule)).otherwise(line(values))

    return F.when(F.size(rows) == 0, table).otherwise(F.array_join(F.transform(rows, with_rule), "\n"))


def clean_html_text(text: Column) -> Column:
    """Drop images, turn bare tables into Markdown, squeeze blank lines, trim."""
    no_images = F.regexp_replace(text, r"<img[^>]*>", "")
    between = F.split(no_images, _TABLE)
    tables = F.transform(F.regexp_extract_all(no_images, F.lit(_TABLE), 0), table_to_markdown)
    woven = F.array_join(
        F.transform(between, lambda piece, i: F.concat(piece, F.coalesce(F.get(tables, i), F.lit("")))), ""
    )
    squeezed = F.regexp_replace(woven, r"(?U)\n\s*\n", "\n\n")
    return F.regexp_replace(squeezed, r"(?U)^\s+|\s+$", "")
