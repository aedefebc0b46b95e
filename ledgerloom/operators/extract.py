"""Invoice and receipt fields from text, as column expressions.

Blank characters follow the wide meaning (no-break and typographic spaces count),
so a label and its value may be separated by any of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import bind
from ..functions.dates import first_date, parse_date

ITEM_TYPE = "struct<description:string,quantity:double,unit_price:double,amount:double>"

# Two ranges first: they turn visible ASCII away before the long list is gone through.
_SP = (
    r"[\x00-\x20\x7f-\u3000&&"
    r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f\u0085]]"
)
# The same characters one by one.
_BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BREAKS = r"\n\r\u000b\f\u001c-\u001e\u0085\u2028\u2029"
_RARE_BREAK = r"[\u0000-\u001f\u007f-\u2029&&[\r\u000b\f\u001c-\u001e\u0085\u2028\u2029]]"
_GAP = rf"{_SP}*[:\-]?{_SP}*\n?{_SP}*"
_AMOUNT = r"[0-9][0-9,]*\.[0-9]{2}"

# Currency codes in the order they are looked for.
CURRENCY_CODES = ("MYR", "USD", "SGD", "EUR", "GBP", "AUD")
CURRENCY_SYMBOLS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"))
# Total labels, most authoritative first.
TOTAL_LABELS = (
    rf"balance{_SP}*due",
    rf"grand{_SP}*total",
    rf"amount{_SP}*due",
    rf"total{_SP}*amount",
    rf"(?<!sub{_SP})(?<!sub)total",
)
# Words without which a label cannot occur, in the same order.
TOTAL_WORDS = (("balance", "due"), ("grand", "total"), ("amount", "due"), ("total", "amount"), ("total",))
# Words that mark a line as a label and not a vendor name.
VENDOR_STOP_WORDS = (
    "invoice", "receipt", "bill to", "ship to", "date", "terms",
    "description", "amount", "quantity", "total", "powered by",
)
# Words that mark a two-column line as a total and not an item.
ITEM_STOP_WORDS = ("total", "subtotal", "tax", "gst", "sst", "balance", "amount due")

_NUMBER_LABEL = rf"(?:invoice|inv|receipt){_SP}*(?:no\.?|number|#)"
_SNIPPET = r"([A-Za-z0-9 ,/\-]{6,24})"
_FULL_ITEM = rf"^(.+?){_SP}+([0-9]+(?:\.[0-9]+)?){_SP}+({_AMOUNT}){_SP}+({_AMOUNT})$"
_SHORT_ITEM = rf"^([A-Za-z][^0-9]{{2,60}}?){_SP}+({_AMOUNT})$"
_SEP = "\u0001"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """Captured group of the first match, NULL when there is none."""
    return bind(F.regexp_extract(text, "(?i)" + pattern, group), lambda v: F.when(v != "", v))


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    def any_of(low: Column) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | low.contains(word)
        return hit

    return bind(F.lower(text), any_of)


def _with_words(low: Column, words: tuple[str, ...], value: Column) -> Column:
    """``value`` where all words occur in the case-folded text, else NULL: a plain search costs far less than a pattern that fails."""
    hit = low.contains(words[0])
    for word in words[1:]:
        hit = hit & low.contains(word)
    return F.when(hit, value)


def _folded(text: Column, low: Column | None) -> Column:
    return F.lower(text) if low is None else low


def candidate_type(text: Column) -> Column:
    """invoice, receipt or NULL; invoice wins when both kinds of words occur."""
    return bind(
        F.lower(text),
        lambda low: F.when(low.contains("invoice") | low.contains("bill to"), "invoice").when(
            low.contains("receipt") | low.contains("payment received"), "receipt"
        ),
    )


def invoice_number(text: Column) -> Column:
    return _found(text, rf"{_NUMBER_LABEL}{_GAP}([A-Za-z0-9][A-Za-z0-9\-/]{{1,19}})")


def amount_after(text: Column, label: str) -> Column:
    symbol = "|".join((*CURRENCY_CODES, r"\$", "RM"))
    value = F.regexp_extract(text, rf"(?i){label}{_GAP}(?:{symbol})?{_SP}*({_AMOUNT})", 1)
    # An empty text is no number, and finding that out costs an exception.
    return bind(value, lambda v: F.when(v != "", _amount_text(v)))


def total_amount(text: Column, low: Column | None = None) -> Column:
    """``low``: the text in lower case, if the caller has it."""
    low, found = _folded(text, low), zip(TOTAL_LABELS, TOTAL_WORDS, strict=True)
    return F.coalesce(*[_with_words(low, words, amount_after(text, label)) for label, words in found])


def date_after(text: Column, label: str) -> Column:
    return parse_date(F.btrim(F.regexp_extract(text, rf"(?i){label}{_GAP}{_SNIPPET}", 1)))


def due_date(text: Column, low: Column | None = None) -> Column:
    return _with_words(_folded(text, low), ("due", "date"), date_after(text, rf"due{_SP}*date"))


def invoice_date(text: Column, low: Column | None = None) -> Column:
    low = _folded(text, low)
    return F.coalesce(
        _with_words(low, ("invoice", "date"), date_after(text, rf"invoice{_SP}*date")),
        _with_words(low, ("date",), date_after(text, rf"(?<!due{_SP})(?<!due)\bdate\b")),
    )


def currency(text: Column) -> Column:
    def choose(upper: Column) -> Column:
        def word(code: str) -> Column:
            # Contains first: the boundary check runs only where the letters occur.
            return upper.contains(code) & upper.rlike(rf"(?<![\p{{L}}\p{{N}}_]){code}(?![\p{{L}}\p{{N}}_])")

        tests = [(word(c), c) for c in CURRENCY_CODES] + [(word("RM"), "MYR")]
        tests += [(text.contains(s), c) for s, c in CURRENCY_SYMBOLS]
        out = F.when(*tests[0])
        for test, code in tests[1:]:
            out = out.when(test, code)
        return out

    return bind(F.upper(text), choose)


def text_lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    # A split by one character needs no pattern.
    lines = F.when(text.rlike(_RARE_BREAK), F.split(text, rf"\r\n|[{_BREAKS}]")).otherwise(F.split(text, "\n"))

    def strip(line: Column) -> Column:
        # Stripping reads the whole line: only where an end is blank.
        blanks = F.lit(_BLANKS)
        ends = blanks.contains(F.substring(line, 1, 1)) | blanks.contains(F.substring(line, -1, 1))
        return F.when(ends, F.btrim(line, blanks)).otherwise(line)

    return F.filter(F.transform(lines, strip), lambda s: s != "")


def vendor(lines: Column) -> Column:
    """First plausible name among the first eight lines."""

    def plausible(line: Column) -> Column:
        return (
            F.length(line).between(2, 60)
            & ~_any_word(line, VENDOR_STOP_WORDS)
            & ~line.rlike(rf"^(?:[0-9.,\-/]|{_SP})+$")
            & ~line.endswith(":")
        )

    # In order up to the first hit; later lines are not looked at.
    return F.coalesce(*[bind(F.get(lines, i), lambda s: F.when(plausible(s), s)) for i in range(8)])


def _amount_text(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("")).try_cast("double")


def _item_of(line: Column) -> Column:
    """Item of a line or NULL: description, quantity, price and amount, else
    description and amount.  One pattern pass splits a line into its parts."""
    def short_item(short: Column) -> Column:
        amount = _amount_text(F.get(short, 1))
        item = F.struct(
            F.btrim(F.get(short, 0)).alias("description"),
            F.lit(1.0).alias("quantity"),
            amount.alias("unit_price"),
            amount.alias("amount"),
        )
        return F.when((F.size(short) == 2) & ~_any_word(F.get(short, 0), ITEM_STOP_WORDS), item)

    def full_item(full: Column) -> Column:
        item = F.struct(
            F.btrim(F.get(full, 0)).alias("description"),
            F.get(full, 1).try_cast("double").alias("quantity"),
            _amount_text(F.get(full, 2)).alias("unit_price"),
            _amount_text(F.get(full, 3)).alias("amount"),
        )
        short = F.split(F.regexp_replace(line, _SHORT_ITEM, f"$1{_SEP}$2"), _SEP)
        return F.when(F.size(full) == 4, item).otherwise(bind(short, short_item))

    return bind(F.split(F.regexp_replace(line, _FULL_ITEM, f"$1{_SEP}$2{_SEP}$3{_SEP}$4"), _SEP), full_item)


def line_items(lines: Column) -> Column:
    """Items in line order.  Only lines that end in an amount are looked at closely."""
    # The third character from the end tells most other lines apart without a pattern.
    amounts = F.filter(lines, lambda s: (F.substring(s, -3, 1) == ".") & s.rlike(rf"{_SP}{_AMOUNT}$"))
    return F.filter(F.transform(amounts, _item_of), lambda i: i.isNotNull()).cast(f"array<{ITEM_TYPE}>")


CANDIDATE_FIELDS = (
    "document_type", "vendor", "invoice_number", "invoice_date", "due_date", "total_amount", "currency", "line_items",
)


def extract_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Candidate fields for every non-blank text; non-candidates have NULL fields.

    Fields are computed only after the keyword gate, so ordinary documents cost
    one case-folded scan of their text.  They come out of a one-row generator:
    later filters on a field then read the finished value, where a projection
    would copy the field's whole expression into every filter above it.
    """
    body = F.col(text)

    def fields_of(read: Column) -> Column:
        lines, low = read["lines"], read["low"]
        return F.struct(
            vendor(lines).alias("vendor"),
            invoice_number(body).alias("invoice_number"),
            invoice_date(body, low).alias("invoice_date"),
            due_date(body, low).alias("due_date"),
            total_amount(body, low).alias("total_amount"),
            currency(body).alias("currency"),
            line_items(lines).alias("line_items"),
        )

    typed = df.withColumn("document_type", candidate_type(body))
    read = F.struct(text_lines(body).alias("lines"), F.lower(body).alias("low"))
    found = F.transform(F.array(read), fields_of)
    return typed.select("*", F.inline_outer(F.when(F.col("document_type").isNotNull(), found)))


def candidate_json(prefix: str = "") -> Column:
    """Extraction result in the camel-case spelling, NULL fields kept."""
    c = lambda n: F.col(prefix + n)
    items = F.transform(
        c("line_items"),
        lambda i: F.struct(
            i["description"].alias("description"),
            i["quantity"].alias("quantity"),
            i["unit_price"].alias("unitPrice"),
            i["amount"].alias("amount"),
        ),
    )
    return F.to_json(
        F.struct(
            c("vendor").alias("vendor"),
            c("invoice_number").alias("invoiceNumber"),
            F.date_format(c("invoice_date"), "yyyy-MM-dd").alias("invoiceDate"),
            F.date_format(c("due_date"), "yyyy-MM-dd").alias("dueDate"),
            c("total_amount").alias("totalAmount"),
            c("currency").alias("currency"),
            items.alias("lineItems"),
        ),
        {"ignoreNullFields": "false"},
    )


# -- text measures and chunks ------------------------------------------------------


def usable_text(text: Column, pages: Column) -> Column:
    """Enough visible characters for a real text layer, growing with the pages."""
    visible = F.length(F.regexp_replace(text, rf"{_SP}+", ""))
    return visible >= F.greatest(F.lit(16), F.lit(8) * F.greatest(pages, F.lit(1)))


def document_date(text: Column, as_of, char_cap: int | None = None) -> Column:
    """First date-like token of the text, unless it is implausible.

    More than three days ahead or over fifty calendar years old gives NULL.
    ``char_cap`` limits the search to the head of the text; None reads all of it.
    """
    head = text if char_cap is None else F.substring(text, 1, char_cap)
    guess = first_date(head)
    today = F.lit(as_of).cast("date")
    sane = (guess <= F.date_add(today, 3)) & (F.year(guess) >= F.year(today) - 50)
    return F.when(sane, guess)


# Model window, output reserve, prompt overhead, margin, characters per token.
MODEL_WINDOW, OUTPUT_RESERVE, OVERHEAD, MARGIN, CHARS_PER_TOKEN = 2048, 768, 200, 50, 1.35
CHUNK_CHARS = int(max(256, MODEL_WINDOW - OUTPUT_RESERVE - OVERHEAD - MARGIN) * CHARS_PER_TOKEN)

_LINE_WITH_END = rf"[^{_BREAKS}]*(?:\r\n|[{_BREAKS}])|[^{_BREAKS}]+"


def chunks(text: Column, budget: int = CHUNK_CHARS, max_chunks: int | None = None) -> Column:
    """Line-aligned pieces of at most ``budget`` characters, filled greedily.

    A longer single line stays whole.  ``max_chunks`` bounds the model calls;
    None keeps every chunk.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, line: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(line) > budget)
        return F.when(
            full, F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), line.alias("open"))
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], line).alias("open")))

    def close(acc: Column) -> Column:
        return F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    lines = F.regexp_extract_all(text, F.lit(_LINE_WITH_END), 0)
    pieces = F.when(F.length(text) <= budget, F.array(text)).otherwise(F.aggregate(lines, start, add, close))
    return pieces if max_chunks is None else F.slice(pieces, 1, max_chunks)


def chunk_table(df: DataFrame, budget: int = CHUNK_CHARS, max_chunks: int | None = None) -> DataFrame:
    """One row per document and chunk."""
    return df.select("id", F.posexplode(chunks(F.col("text"), budget, max_chunks)).alias("chunk_no", "chunk"))


MIN_MODEL_TEXT = 8


def _model_text() -> Column:
    return F.regexp_replace(F.coalesce("text", F.lit("")), rf"^{_SP}+|{_SP}+$", "")


def model_input_mode() -> Column:
    """``text`` for a document with a text layer and enough text, else ``vision``."""
    usable = F.coalesce("has_text_layer", F.lit(False)) & (F.length(_model_text()) >= MIN_MODEL_TEXT)
    return F.when(usable, "text").otherwise("vision")


def model_work_list(df: DataFrame, max_calls: int | None = None) -> DataFrame:
    """Model calls for routed documents: mode, pass and chunk.

    Text mode: one header call on the first chunk, then one item call per chunk
    (with ``max_calls``, one call less than that).  Documents without usable text become a
    single vision row.  Input: id, text, has_text_layer.
    """
    moded = df.select("id", model_input_mode().alias("mode"), _model_text().alias("text"))
    pieces = F.when(F.col("mode") == "text", chunks(F.col("text"), max_chunks=max_calls)).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    rows = moded.select("id", "mode", F.posexplode(pieces).alias("chunk_no", "chunk"))
    items = F.lit(True) if max_calls is None else F.col("chunk_no") < max_calls - 1
    passes = F.filter(
        F.array(
            F.when(F.col("mode") == "vision", F.lit("vision")),
            F.when((F.col("mode") == "text") & (F.col("chunk_no") == 0), F.lit("header")),
            F.when((F.col("mode") == "text") & items, F.lit("items")),
        ),
        lambda p: p.isNotNull(),
    )
    return rows.select("id", "mode", "chunk_no", "chunk", F.explode(passes).alias("call"))
