"""Amounts, typed columns, key aliases and JSON object edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonvalues as jv
from ..functions.binding import bind

# Raw key -> canonical key.
KEY_ALIASES = {
    "vendor_name": "vendor",
    "supplier": "vendor",
    "company_name": "vendor",
    "seller_name": "vendor",
    "biller": "vendor",
    "invoice_no": "invoiceNumber",
    "invoice_number": "invoiceNumber",
    "doc_number": "invoiceNumber",
    "document_number": "invoiceNumber",
    "receipt_no": "invoiceNumber",
    "receipt_number": "invoiceNumber",
    "reference_number": "invoiceNumber",
    "ref_no": "invoiceNumber",
    "grand_total": "totalAmount",
    "total_amount": "totalAmount",
    "total": "totalAmount",
    "amount_due": "totalAmount",
    "balance_due": "totalAmount",
    "amount_payable": "totalAmount",
    "net_total": "totalAmount",
    "sub_total": "subtotal",
    "subtotal_amount": "subtotal",
    "sub_total_amount": "subtotal",
    "tax_amount": "tax",
    "gst": "tax",
    "vat": "tax",
    "tax_rate": "taxRate",
    "gst_rate": "taxRate",
    "invoice_date": "invoiceDate",
    "date": "invoiceDate",
    "document_date": "invoiceDate",
    "receipt_date": "invoiceDate",
    "issue_date": "invoiceDate",
    "due_date": "dueDate",
    "payment_due_date": "dueDate",
    "currency_code": "currency",
    "customer_name": "customerName",
    "client_name": "customerName",
    "bill_to": "customerName",
    "sold_to": "customerName",
    "customer_address": "customerAddress",
    "client_address": "customerAddress",
    "vendor_address": "vendorAddress",
    "supplier_address": "vendorAddress",
    "line_items": "lineItems",
    "items": "lineItems",
    "products": "lineItems",
    "document_type": "documentType",
    "doc_type": "documentType",
    "type": "documentType",
}
# Keys that hold lists and are never columns.
LIST_KEYS = ("lineItems", "line_items", "items", "products")
# Keys of a configuration that are not part of its schema.
CONFIG_KEYS = ("_instruction", "_rules", "_original_schema_str")
LEGACY_CONFIG_KEYS = ("_hints", "_prompt")


def canonical_key(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KEY_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def winning_keys(obj: Column) -> Column:
    """For each canonical key the raw key that wins, as (size, raw, canonical).

    The archive database orders object keys by length and then bytewise; the
    first key of a concept in that order wins.
    """
    ranked = F.array_sort(
        F.transform(
            F.map_keys(obj),
            lambda k: F.struct(F.length(k).alias("size"), k.alias("raw"), canonical_key(k).alias("canonical")),
        )
    )

    def winners(listed: Column) -> Column:
        names = F.transform(listed, lambda r: r["canonical"])
        return bind(
            names,
            lambda seen: F.filter(listed, lambda e, i: F.array_position(seen, e["canonical"]) == i + 1),
        )

    return bind(ranked, winners)


def alias_keys(df: DataFrame, column: str = "extracted_data") -> DataFrame:
    """Add ``fields``: canonical key -> variant value, and ``_won``: the raw keys."""
    return (
        df.withColumn("_obj", jv.as_object(F.col(column)))
        .withColumn("_won", winning_keys(F.col("_obj")))
        .withColumn(
            "fields",
            F.map_from_entries(
                F.transform("_won", lambda e: F.struct(e["canonical"], F.element_at(F.col("_obj"), e["raw"])))
            ),
        )
        .drop("_obj")
    )


# -- amounts -------------------------------------------------------------------


def parse_amount_text(text: Column) -> Column:
    """Keep digits and dots, then read a number; signs and commas are dropped."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def parse_amount(value: Column) -> Column:
    """Amount of a JSON value: numbers as they are, text through its digits."""
    return bind(
        value,
        lambda v: F.when(jv.is_number(v), jv.number_of(v))
        .when(jv.is_boolean(v), jv.text_of(v).try_cast("boolean").cast("double"))
        .when(jv.is_string(v), parse_amount_text(jv.text_of(v))),
    )


NUMBER_TEXT = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def coerce_amount_text(text: Column) -> Column:
    """Drop commas and outer blanks, then require a plain signed number."""
    cleaned = F.btrim(F.replace(text, F.lit(","), F.lit("")), F.lit(jv.BLANKS))
    return bind(cleaned, lambda c: F.when(c.rlike(NUMBER_TEXT), c.try_cast("double")))


def coerce_amount(value: Column) -> Column:
    return bind(
        value,
        lambda v: F.when(jv.is_number(v), jv.number_of(v))
        .when(jv.is_boolean(v), jv.text_of(v).try_cast("boolean").cast("double"))
        .when(jv.is_string(v), coerce_amount_text(jv.text_of(v))),
    )


# -- typed columns ---------------------------------------------------------------


def typed_fields(df: DataFrame, column: str = "extracted_data") -> DataFrame:
    """Add ``typed``: vendor, invoice_no, total_amount and currency of the JSON.

    Only the two flat spellings are read; nested results give NULLs.
    """
    obj = F.col("_obj")
    number = jv.first_present(jv.key(obj, "invoiceNumber"), jv.key(obj, "invoice_number"))
    total = jv.first_present(jv.key(obj, "totalAmount"), jv.key(obj, "total_amount"), jv.key(obj, "grand_total"))
    return (
        df.withColumn("_obj", jv.as_object(F.col(column)))
        .withColumns({"_number": number, "_total": total})
        .withColumn(
            "typed",
            F.struct(
                jv.filled_text(jv.key(obj, "vendor")).alias("vendor"),
                jv.filled_text(F.col("_number")).alias("invoice_no"),
                coerce_amount(F.col("_total")).alias("total_amount"),
                jv.filled_text(jv.key(obj, "currency")).alias("currency"),
            ),
        )
        .drop("_obj", "_number", "_total")
    )


def backfill_typed_columns(df: DataFrame) -> DataFrame:
    """Refresh the typed columns of rows with data; all-empty results change nothing."""
    names = ("vendor", "invoice_no", "total_amount", "currency")
    filled = typed_fields(df)
    useful = F.coalesce(*[F.col(f"typed.{n}").cast("string") for n in names]).isNotNull()
    amount = F.col("typed.total_amount").try_cast("decimal(12,2)")
    replacement = {n: F.col(f"typed.{n}") for n in names} | {"total_amount": amount}
    return filled.withColumns(
        {n: F.when(useful, replacement[n]).otherwise(F.col(n)) for n in names}
    ).drop("typed")


def backfill_title(df: DataFrame) -> DataFrame:
    return df.withColumn("title", F.coalesce("title", "original_filename"))


def auto_title(vendor: Column, invoice_no: Column) -> Column:
    """``vendor — number`` when both are present, else NULL."""
    both = (F.length(vendor) > 0) & (F.length(invoice_no) > 0)
    return F.when(both, F.concat_ws(" — ", vendor, invoice_no))


def effective_retention_days(column: str = "trash_retention_days", default: int = 30) -> Column:
    return F.coalesce(F.col(column), F.lit(default))


# -- object edits ------------------------------------------------------------------


def shallow_merge(data: Column, patch: Column) -> Column:
    """Patch keys overwrite, all other keys stay.  Needs the LAST_WIN map policy."""
    empty = F.create_map().cast(jv.OBJECT)
    return F.to_json(F.map_concat(F.coalesce(jv.as_object(data), empty), F.coalesce(jv.as_object(patch), empty)))


def split_config(df: DataFrame, column: str, instruction: str | None = None, rules: str | None = None) -> DataFrame:
    """Split a configuration into ``clean_schema`` (map), ``instruction`` and ``rules``.

    A parseable original schema text replaces the stored keys.
    """
    obj = F.col("_obj")
    original = jv.as_object(jv.text_of(jv.key(obj, "_original_schema_str")))
    stored = F.map_filter(obj, lambda k, v: ~k.isin(*CONFIG_KEYS))
    return (
        df.withColumn("_obj", jv.as_object(F.col(column)))
        .withColumn("_kept", F.coalesce(original, stored))
        .withColumns(
            {
                "clean_schema": F.map_filter("_kept", lambda k, v: ~k.isin(*LEGACY_CONFIG_KEYS)),
                "instruction": F.coalesce(jv.text_of(jv.key(obj, "_instruction")), F.lit(instruction)),
                "rules": F.coalesce(jv.text_of(jv.key(obj, "_rules")), F.lit(rules)),
            }
        )
        .drop("_obj", "_kept")
    )
