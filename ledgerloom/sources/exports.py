"""CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import limit_with_truncation_flag, sort_columns

BYTE_ORDER_MARK = "\ufeff"
# Header of the document export.
EXPORT_COLUMNS = (
    "Title", "Vendor", "Invoice No", "Total Amount", "Currency", "Document Type", "Status", "Document Date", "Uploaded At",
)


def export_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Export columns as text, newest first; ``limit=None`` exports every row.

    With a limit, the column ``truncated`` tells whether rows were left out.
    """
    order = sort_columns("date_desc")
    rows = df.orderBy(*order) if limit is None else limit_with_truncation_flag(df, order, limit).orderBy("row_no")
    blank = lambda c: F.coalesce(c, F.lit(""))
    micros = F.date_format("uploaded_at", "SSSSSS")
    stamp = F.concat(
        F.date_format("uploaded_at", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )
    values = (
        F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("original_filename")),
        blank(F.col("vendor")),
        blank(F.col("invoice_no")),
        blank(F.col("total_amount").cast("decimal(12,2)").cast("string")),
        blank(F.col("currency")),
        F.col("document_type"),
        F.col("status"),
        blank(F.date_format("document_date", "yyyy-MM-dd")),
        blank(stamp),
    )
    out = [value.alias(name) for name, value in zip(EXPORT_COLUMNS, values)]
    return rows.select(*out, *(["truncated"] if limit is not None else []))


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """CSV with header, empty cells for NULL and, with ``mark``, a byte order mark.

    Every part file is a complete CSV of its slice of the order.
    """
    if mark:
        df = df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").option(
        "escape", '"'
    ).csv(path)


def spreadsheet_csv_rows(rows: DataFrame) -> DataFrame:
    """Cells as text: NULL is empty, lists and structs become JSON."""
    cells = []
    for field in rows.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        text = F.to_json(column) if kind in ("array", "struct", "map", "variant") else column.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(field.name))
    return rows.select(*cells)


def export_spreadsheet_csv(rows: DataFrame, path: str, order: list | None = None) -> None:
    ordered = rows if order is None else rows.orderBy(*order)
    write_csv(spreadsheet_csv_rows(ordered), path, mark=False)
