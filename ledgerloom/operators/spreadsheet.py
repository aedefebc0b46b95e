"""Spreadsheet rows from extraction JSON, field discovery and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonvalues as jv
from ..functions.binding import bind
from .normalize import LIST_KEYS, alias_keys, canonical_key, parse_amount, split_config

META = ("filename", "documentType", "status", "uploadedAt", "documentDate")
# Canonical keys shown as numbers.
NUMERIC_KEYS = ("totalAmount", "subtotal", "tax", "discount")


def _header(columns: list[str]) -> list[Column]:
    """Document part of a row: five fixed columns, then the chosen ones."""
    out = [
        F.col("id"),
        F.col("original_filename").alias("filename"),
        F.col("document_type").alias("documentType"),
        F.col("status"),
        F.date_format("uploaded_at", "yyyy-MM-dd").alias("uploadedAt"),
        F.date_format("document_date", "yyyy-MM-dd").alias("documentDate"),
    ]
    for name in columns:
        if name not in META:
            value = jv.key(F.col("fields"), name)
            out.append((parse_amount(value) if name in NUMERIC_KEYS else jv.text_of(value)).alias(name))
    return out


def _items(df: DataFrame) -> DataFrame:
    """Add ``_items``: the line items, NULL when the value is set but no list."""
    value = jv.key(F.col("fields"), "lineItems")
    empty = F.array().cast(jv.LIST)
    listed = bind(value, lambda v: F.when(jv.present(v), jv.elements(v)).otherwise(empty))
    return df.withColumn("_items", listed)


def summary_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per document; the line items shrink to their count."""
    return _items(alias_keys(df)).select(
        *_header(columns), F.when(F.col("_items").isNotNull(), F.size("_items")).alias("itemCount")
    )


def _row(depth: int, sub_no: Column, text: Column, quantity: Column, price: Column, amount: Column) -> Column:
    return F.struct(
        F.lit(depth).alias("depth"),
        sub_no.cast("int").alias("sub_no"),
        jv.text_of(text).alias("itemDescription"),
        jv.text_of(quantity).alias("itemQuantity"),
        parse_amount(price).alias("itemUnitPrice"),
        parse_amount(amount).alias("itemAmount"),
    )


def _field(item: Column, *names: str) -> Column:
    return jv.first_present(*[F.try_variant_get(item, f"$.{n}", "variant") for n in names])


def _item_rows(item: Column) -> Column:
    """The row of a line item followed by the rows of its sub-items."""
    parent = _row(
        0,
        F.lit(-1),
        _field(item, "description", "parent_item_description", "item_description", "name"),
        _field(item, "quantity", "parent_quantity", "qty"),
        _field(item, "unit_price", "parent_unit_price", "unitPrice"),
        _field(item, "amount", "parent_total_amount", "total_amount", "totalAmount"),
    )
    subs = jv.elements(_field(item, "sub_items", "subItems"))
    blank = F.array().cast(jv.LIST)
    numbered = F.filter(
        F.transform(F.coalesce(subs, blank), lambda s, j: F.struct(j.alias("j"), s.alias("s"))), lambda e: jv.is_object(e["s"])
    )
    children = F.transform(
        numbered,
        lambda e: _row(
            1,
            e["j"],
            _field(e["s"], "sub_item_description", "description", "name"),
            _field(e["s"], "sub_quantity", "quantity"),
            _field(e["s"], "sub_unit_price", "unit_price"),
            _field(e["s"], "sub_total_amount", "amount"),
        ),
    )
    return F.concat(F.array(parent), children)


def expanded_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per line item (depth 0) and sub-item (depth 1), header repeated.

    No items: one row with empty item columns.  Elements that are no objects are
    skipped, so a list of only those gives no row.  All of it is one pass over
    the documents without a shuffle.
    """
    rows = _items(alias_keys(df)).withColumn("_has", F.coalesce(F.size("_items") > 0, F.lit(False)))
    # NULL element = the blank row of a document without items.
    blank = F.array(F.lit(None).cast("variant"))
    exploded = rows.select(
        *_header(columns), "_has", F.posexplode(F.when(F.col("_has"), F.col("_items")).otherwise(blank)).alias("item_no", "_item")
    ).filter(~F.col("_has") | jv.is_object(F.col("_item")))
    null = F.lit(None).cast("variant")
    blank_row = F.array(_row(0, F.lit(-1), null, null, null, null))
    header = [c for c in exploded.columns if c not in ("_has", "_item")]
    return exploded.select(
        *header, F.inline(F.when(F.col("_has"), _item_rows(F.col("_item"))).otherwise(blank_row))
    )


def expanded_order() -> list[Column]:
    return [F.desc("uploadedAt"), F.asc("id"), F.asc("item_no"), F.asc("depth"), F.asc("sub_no")]


def preview(rows: DataFrame, order: list[Column], shown: int = 50) -> DataFrame:
    """First rows of a spreadsheet for the screen; only these ever reach a driver."""
    return rows.orderBy(*order).limit(shown)


# -- field discovery -----------------------------------------------------------------


def schema_keys(
    templates: DataFrame, types: DataFrame, tenant: str, document_type: str | None = None, template_id=None
) -> DataFrame:
    """Raw keys of the schema in force: named template, else promoted, else type."""
    own = templates.filter(F.col("tenant_id") == tenant)
    if template_id is not None:
        source = own.filter(F.col("id") == template_id).select(F.col("field_mappings").alias("config"))
    elif document_type is not None:
        typed = types.filter(F.col("name") == document_type)
        promoted = own.filter("status = 'promoted'").join(
            typed.select(F.col("id").alias("document_type_id")), "document_type_id", "left_semi"
        )
        visible = typed.filter((F.col("tenant_id") == tenant) | F.col("tenant_id").isNull())
        ranked = promoted.select(F.lit(0).alias("step"), "id", F.col("field_mappings").alias("config")).unionByName(
            visible.select(F.lit(1).alias("step"), "id", F.col("json_schema").alias("config"))
        )
        source = ranked.agg(F.min_by("config", F.struct("step", "id")).alias("config"))
    else:
        source = own.filter(F.lit(False)).select(F.col("field_mappings").alias("config"))
    return split_config(source, "config").select(F.explode(F.map_keys("clean_schema")).alias("raw"))


def observed_keys(df: DataFrame) -> DataFrame:
    """Distinct top-level keys; duplicates collapse in each task before the shuffle."""
    return df.select(F.explode(F.json_object_keys("extracted_data")).alias("raw")).distinct()


def discover_fields(df: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """Canonical column names in the data and the schema, list keys dropped, sorted."""
    raw = observed_keys(df)
    if schema is not None:
        raw = raw.unionByName(schema)
    named = raw.select(canonical_key(F.col("raw")).alias("field")).distinct()
    return named.filter(~F.col("field").isin(*LIST_KEYS)).orderBy("field")
