"""File intake: reading batches, classifying content, allow-list and size checks."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.binding import bind
from ..operators.aggregates import quota_check
from ..operators.joins import ingest_dedup

MAX_FILE_MB = 50
MAX_BATCH_FILES = 50

_OFFICE = "application/vnd.openxmlformats-officedocument."
# Accepted media type -> stored extension.
ALLOWED_TYPES = {
    "application/pdf": "pdf",
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/webp": "webp",
    "image/tiff": "tif",
    _OFFICE + "wordprocessingml.document": "docx",
    _OFFICE + "spreadsheetml.sheet": "xlsx",
    _OFFICE + "presentationml.presentation": "pptx",
    "text/plain": "txt",
    "text/csv": "csv",
    "text/markdown": "md",
    "message/rfc822": "eml",
    "application/xml": "xml",
}
# Member that tells the kind of an office container.
OFFICE_MEMBERS = (
    ("word/document.xml", _OFFICE + "wordprocessingml.document"),
    ("xl/workbook.xml", _OFFICE + "spreadsheetml.sheet"),
    ("ppt/presentation.xml", _OFFICE + "presentationml.presentation"),
)
# Extension -> text subtype; anything else is plain text.
TEXT_EXTENSIONS = {
    "csv": "text/csv", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "xml": "application/xml",
}
# Headers of which two make a text an email.
MAIL_HEADERS = ("From", "To", "Subject", "Date", "Message-ID", "Return-Path")


def read_files(spark: SparkSession, path: str, max_mb: int = MAX_FILE_MB, pattern: str = "*") -> DataFrame:
    """Files of a folder with name, size and bytes.

    Bytes of files over the limit are never read: the size filter is pushed to
    the file listing and those rows come back with NULL content.
    """
    cap = max_mb * 1024 * 1024
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    small = files.filter(F.col("length") <= cap).select("path", name.alias("filename"), F.col("length").alias("size_bytes"), "content")
    large = files.filter(F.col("length") > cap).select(
        "path", name.alias("filename"), F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large)


@pandas_udf(T.StringType())
def _office_kind(contents: pd.Series) -> pd.Series:
    """Media type of an office container by its member names; NULL if unreadable."""

    def one(data):
        if data is None:
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                members = set(archive.namelist())
        except zipfile.BadZipFile:
            return None
        return next((kind for member, kind in OFFICE_MEMBERS if member in members), None)

    return contents.map(one)


def _starts(content: Column, *prefixes: bytes) -> Column:
    out = F.lit(False)
    for prefix in prefixes:
        out = out | (F.substring(content, 1, len(prefix)) == F.lit(prefix))
    return out


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, falling back to Latin-1."""
    valid = F.is_valid_utf8(content)
    return F.when(valid, F.decode(F.when(valid, content), "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def _latin1_text(content: Column) -> Column:
    """Is this legacy text: no zero byte and over 95 % ordinary bytes at the start?"""
    sample = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    odd = F.regexp_replace(sample, r"[\x20-\x7e\t\n\r\xa0-\xff]", "")
    return ~F.contains(content, F.lit(b"\x00")) & ((F.length(sample) - F.length(odd)) / F.length(sample) > 0.95)


def _is_mail(text: Column) -> Column:
    block = F.regexp_extract(
        F.substring(text, 1, 4096), r"^(?:(?:From |[\x21-\x39\x3b-\x7e]+:|[ \t])[^\r\n]*(?:\r\n|\r|\n|$))*", 0
    )
    found = [
        F.when(block.rlike(rf"(?im)^{name}:(?:[ \t]*\S|[ \t]*\r?\n[ \t]+\S)"), 1).otherwise(0) for name in MAIL_HEADERS
    ]
    return sum(found[1:], found[0]) >= 2


def classify_content(df: DataFrame) -> DataFrame:
    """Add ``mime_type`` from the leading bytes; the name only picks a text subtype.

    Unrecognised content gets NULL.  Only zip containers leave the JVM.
    """
    content, name = F.col("content"), F.col("filename")
    is_zip = _starts(content, b"PK\x03\x04")
    binary = (
        F.when(_starts(content, b"%PDF-"), "application/pdf")
        .when(_starts(content, b"\x89PNG\r\n\x1a\n"), "image/png")
        .when(_starts(content, b"\xff\xd8\xff"), "image/jpeg")
        .when(_starts(content, b"RIFF") & (F.substring(content, 9, 4) == F.lit(b"WEBP")), "image/webp")
        .when(_starts(content, b"II*\x00", b"MM\x00*"), "image/tiff")
    )
    extension = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    subtype = F.lit("text/plain")
    for ext, kind in TEXT_EXTENSIONS.items():
        subtype = F.when(extension == ext, kind).otherwise(subtype)
    staged = df.withColumns({"_binary": binary, "_office": _office_kind(F.when(is_zip, content))})
    candidate = F.col("_binary").isNull() & ~is_zip & (F.is_valid_utf8(content) | _latin1_text(content))
    text = F.when(candidate, decode_text(content))
    kind = F.when(_is_mail(text), "message/rfc822").when(text.rlike(r"(?U)^\s*<\?xml"), "application/xml").otherwise(subtype)
    return staged.withColumn("_text", text).withColumn(
        "mime_type",
        F.when(F.col("_binary").isNotNull(), F.col("_binary"))
        .when(is_zip, F.col("_office"))
        .when(F.col("_text").isNotNull(), kind),
    ).drop("_binary", "_office", "_text")


def stored_extension(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ALLOWED_TYPES.items() for x in pair])
    return F.try_element_at(table, mime)


def check_files(df: DataFrame, max_mb: int = MAX_FILE_MB) -> DataFrame:
    """Add ``ext`` and ``reject_reason`` (NULL for accepted files)."""
    ext = stored_extension(F.col("mime_type"))
    too_big = F.col("size_bytes") > max_mb * 1024 * 1024
    reason = F.when(too_big, "too_large").when(ext.isNull(), "unsupported_type")
    return df.withColumns({"ext": ext, "reject_reason": reason})


def accept_or_reject(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of checked files."""
    return df.filter("reject_reason IS NULL"), df.filter("reject_reason IS NOT NULL")


def batch_count_cap(df: DataFrame, limit: int = MAX_BATCH_FILES) -> DataFrame:
    """Files of batches that hold at most ``limit`` files."""
    too_many = df.groupBy("batch_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("batch_id")
    return df.join(too_many, "batch_id", "left_anti")


def new_documents(files: DataFrame, tenant: str) -> DataFrame:
    """Document rows for accepted files: queued, titled by file name, with a key.

    The id is a hash of tenant, path and checksum, so that a task that runs twice
    gives the same document.
    """
    checksum = F.sha2("content", 256)
    hashed = files.select("*", F.lit(tenant).alias("tenant_id"), checksum.alias("checksum"))
    doc_id = F.sha2(F.concat_ws("|", "tenant_id", "path", "checksum"), 256)
    return hashed.select(
        doc_id.alias("id"),
        "tenant_id",
        F.col("filename").alias("original_filename"),
        F.col("filename").alias("title"),
        "mime_type",
        "size_bytes",
        "checksum",
        F.lit("queued").alias("status"),
        F.concat(F.col("tenant_id"), F.lit("/docs/"), doc_id, F.lit("."), F.col("ext")).alias("storage_key"),
        "path",
        "content",
    )


def ingest_files(spark: SparkSession, path: str, tenant: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Read, classify, check, hash and deduplicate one folder of files."""
    return ingest_rows(read_files(spark, path), tenant, existing)


def ingest_rows(files: DataFrame, tenant: str, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """The same for files already read (path, filename, size_bytes, content)."""
    checked = check_files(classify_content(files))
    accepted, rejected = accept_or_reject(checked)
    docs = new_documents(accepted, tenant).drop("content")
    fresh = docs
    if existing is not None:
        fresh = ingest_dedup(docs.withColumn("idx", F.col("path")), existing).drop("idx").select(*docs.columns)
    return {"documents": fresh, "rejected": rejected.drop("content"), "all": docs}


def ingest_quota(documents: DataFrame, tenants: DataFrame) -> DataFrame:
    """Accept or reject the whole batch of a tenant by its storage limit."""
    return quota_check(tenants, documents)


# -- invoice XML ----------------------------------------------------------------------

# Fixed value: namespace of the invoice root element.
INVOICE_NAMESPACE = "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"

_LINE = (
    "struct<InvoicedQuantity:string,LineExtensionAmount:string,Item:struct<Name:string>,Price:struct<PriceAmount:string>>"
)
_INVOICE = (
    "ID string, IssueDate string, DueDate string, DocumentCurrencyCode string, "
    "AccountingSupplierParty struct<Party:struct<PartyLegalEntity:struct<RegistrationName:string>,PartyName:struct<Name:string>>>, "
    f"LegalMonetaryTotal struct<PayableAmount:string>, InvoiceLine array<{_LINE}>, _broken string"
)


def _safe_xml(text: Column) -> Column:
    """Text without document type or entity declarations before its root element, else NULL."""
    bare = F.when(text.contains("<!--"), F.regexp_replace(text, r"(?s)<!--.*?-->", "")).otherwise(text)
    head = F.regexp_extract(bare, r"(?s)^(.*?)(?:<[A-Za-z_]|$)", 1)
    checked = bind(head, lambda h: F.when(~h.contains("<!DOCTYPE") & ~h.contains("<!ENTITY"), text))
    # Without "<!" there is neither a comment nor a declaration.
    return F.when(~text.contains("<!"), text).otherwise(checked)


_MISC = r"(?:\s|<\?.*?\?>|<!--.*?-->)*"
# One root element with nothing but comments around it.
_ONE_ROOT = rf"(?s)^\x{{FEFF}}?{_MISC}<([A-Za-z_][\w.:-]*)(?:\s[^>]*)?(?:/>|>.*</\1\s*>){_MISC}$"


def _filled(c: Column) -> Column:
    t = F.btrim(c, F.lit(" \t\r\n"))
    return F.when(t != "", t)


def _xml_number(c: Column) -> Column:
    t = F.btrim(c, F.lit(" \t\r\n"))
    return F.when(t.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def _xml_date(c: Column) -> Column:
    t = F.substring(_filled(c), 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def read_ubl_invoices(df: DataFrame, text: str = "xml") -> DataFrame:
    """Invoice fields of UBL 2.1 texts, one row per readable invoice.

    Unsafe, malformed and other XML gives no row; a bad number or date is NULL.
    Element prefixes are removed first, so any prefix may be used.
    """
    # Each step is bound: a projection or generator would copy the check of the whole text into every mention.
    def bare_of(safe: Column) -> Column:
        def checked(root: Column) -> Column:
            prefix = F.regexp_extract(root, r"^<([A-Za-z_][\w.-]*):Invoice[\s>/]", 1)
            default_ns = root.rlike(rf"^<Invoice\s[^>]*\bxmlns\s*=\s*[\"']{INVOICE_NAMESPACE}[\"']")
            prefixed_ns = (prefix != "") & F.contains(
                F.regexp_replace(root, r"\s*=\s*[\"']", "="), F.concat(F.lit("xmlns:"), prefix, F.lit(f"={INVOICE_NAMESPACE}"))
            )
            is_invoice = F.coalesce((default_ns | prefixed_ns) & safe.rlike(_ONE_ROOT), F.lit(False))
            return F.when(is_invoice, F.regexp_replace(safe, r"<(/?)[A-Za-z_][\w.-]*:", "<$1"))

        return bind(F.regexp_extract(safe, rf"(?s)^\x{{FEFF}}?{_MISC}(<[^>]*>)", 1), checked)

    bare = bind(_safe_xml(F.col(text)), bare_of)
    parsed = F.from_xml(bare, _INVOICE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    # A one-row generator: the document is parsed once, whatever reads the fields.
    rows = df.select("*", F.explode(F.array(parsed)).alias("x")).filter("x IS NOT NULL AND x._broken IS NULL")
    legal = _filled(F.col("x.AccountingSupplierParty.Party.PartyLegalEntity.RegistrationName"))
    party = _filled(F.col("x.AccountingSupplierParty.Party.PartyName.Name"))
    lines = F.transform(
        F.coalesce(F.col("x.InvoiceLine"), F.array().cast(f"array<{_LINE}>")),
        lambda l: F.struct(
            _filled(l["Item"]["Name"]).alias("description"),
            _xml_number(l["InvoicedQuantity"]).alias("quantity"),
            _xml_number(l["Price"]["PriceAmount"]).alias("unit_price"),
            _xml_number(l["LineExtensionAmount"]).alias("amount"),
        ),
    )
    return rows.select(
        *df.columns,
        F.lit("invoice").alias("document_type"),
        F.coalesce(legal, party).alias("vendor"),
        _filled(F.col("x.ID")).alias("invoice_number"),
        _xml_date(F.col("x.IssueDate")).alias("invoice_date"),
        _xml_date(F.col("x.DueDate")).alias("due_date"),
        _xml_number(F.col("x.LegalMonetaryTotal.PayableAmount")).alias("total_amount"),
        _filled(F.col("x.DocumentCurrencyCode")).alias("currency"),
        lines.alias("line_items"),
    )


_XML_TOKEN = r"""(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<(?:[^>"']|"[^"]*"|'[^']*')*+>|[^<]+"""
_NUMERIC_REF = r"&#(?:x[0-9A-Fa-f]+|[0-9]+);"
# The five named entities of XML, the ampersand last.
_XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _unescape(text: Column) -> Column:
    def code(ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"([0-9A-Fa-f]+);", 1)
        number = F.when(ref.startswith("&#x"), F.upper(digits)).otherwise(F.conv(digits, 10, 16))
        return F.decode(F.unhex(F.lpad(number, 8, "0")), "UTF-32")

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMERIC_REF), 0))
    out = F.aggregate(refs, text, lambda t, ref: F.replace(t, ref, code(ref)))
    for name, char in _XML_ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def flatten_xml_text(df: DataFrame, text: str = "xml") -> DataFrame:
    """Add ``xml_text``: all text nodes, trimmed and joined by blanks ('' if unreadable)."""
    safe = _safe_xml(F.col(text))
    check = F.from_xml(safe, "_broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    ok = check.isNotNull() & check["_broken"].isNull() & safe.rlike(_ONE_ROOT)
    # Tags separate text nodes; comments and instructions leave no trace.
    pieces = F.transform(
        F.regexp_extract_all(F.when(ok, safe), F.lit(_XML_TOKEN), 0),
        lambda t: F.when(t.startswith("<![CDATA["), F.regexp_replace(t, r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
        .when(t.startswith("<!--") | t.startswith("<?"), "")
        .when(t.startswith("<"), "\u0001")
        .otherwise(_unescape(t)),
    )
    nodes = F.transform(
        F.split(F.array_join(pieces, ""), "\u0001"), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    )
    joined = F.array_join(F.filter(nodes, lambda t: t != ""), " ")
    return df.withColumn("xml_text", F.coalesce(joined, F.lit("")))
