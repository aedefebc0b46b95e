"""Chat formatting with Spark expressions only (operator 12).

The rows of a conversation are collected as structs and sorted; runs of neighbours with one role become
one message by array aggregation; messages are concatenated to one text::

    <|im_start|>role\\n text <|im_sep|> text <|im_end|>\\n

``<|im_sep|>`` stands between the texts of a merged message, so every row can be read back.  Inside a text
``<``, backslashes and ``|`` get one more backslash, so no control string of the template (each begins with
``<|``) can be part of a text; reading takes it away again.  A role is written with ``%``, line feeds and
``<`` as ``%25``, ``%0A`` and ``%3C``.  ``loss_spans`` are the places of the assistant's texts, one span per
row, as bytes of the UTF-8 text: they can be cut out in one pass, however long the text is.

Defined results: rows are ordered by turn (null first), then role and text, so ties and repeated rows keep
a fixed order and each counts; null text and null role are empty; rows without conv_id form one conversation
without id; an empty table gives an empty result; other columns of the input are not read.  A conversation
is one cell of the result, so it must fit into a cell (2 GB); nothing else is held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"

_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))
_BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + x)


def _grow(totals: Column, x: Column) -> Column:
    return F.concat(totals, F.array(F.element_at(totals, -1) + x))


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each entry, block by block (an array is copied once per entry it gains)."""
    zero = F.array(F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    bases = F.aggregate(blocks, zero, lambda totals, block: _grow(totals, _total(block)))
    within = F.transform(
        F.arrays_zip(blocks.alias("block"), F.slice(bases, F.lit(1), F.size(blocks)).alias("base")),
        lambda p: F.slice(F.aggregate(p["block"], F.array(p["base"]), _grow), F.lit(1), F.size(p["block"])),
    )
    return F.flatten(within)


def messages(turns: DataFrame) -> DataFrame:
    """conv_id and its messages (role, escaped texts): collected, sorted, neighbours of one role merged."""
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row"), _order).alias("rows"))
    heads = F.filter(
        F.sequence(F.lit(1), F.size("rows")),
        lambda i: (i == 1) | (F.element_at("rows", i)["role"] != F.element_at("rows", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ends = F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array(F.size("rows") + 1))
    return (
        sorted_rows.withColumn("heads", heads)
        .withColumn("spans", F.arrays_zip(F.col("heads").alias("head"), ends.alias("next")))
        .select(
            "conv_id",
            F.transform(
                "spans",
                lambda s: F.struct(
                    F.element_at("rows", s["head"])["role"].alias("role"),
                    F.transform(F.slice("rows", s["head"], s["next"] - s["head"]), lambda r: escape(r["text"])).alias("texts"),
                ),
            ).alias("messages"),
        )
    )


def _order(a: Column, b: Column) -> Column:
    """Turn (null first), then role and text."""
    keys = [(F.coalesce(x["turn"], F.lit(-(1 << 63)).cast("long")), x["turn"].isNotNull(), x["role"], x["text"]) for x in (a, b)]
    out = F.lit(0)
    for x, y in reversed(list(zip(*keys))):
        out = F.when(x < y, -1).when(x > y, 1).otherwise(out)
    return out


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start, bytes), n_messages and n_rows of every conversation."""
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.concat(
                F.array(F.struct(F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss"))),
                F.slice(
                    F.flatten(
                        F.transform(
                            m["texts"],
                            lambda t: F.array(
                                F.struct(t.alias("text"), (m["role"] == LOSS_ROLE).alias("loss")),
                                F.struct(F.lit(SEP).alias("text"), F.lit(False).alias("loss")),
                            ),
                        )
                    ),
                    F.lit(1),
                    2 * F.size(m["texts"]) - 1,
                ),
                F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))),
            ),
        )
    )
    rows = _total(F.transform("messages", lambda m: F.size(m["texts"]).cast("long")))
    laid = messages(turns).select("conv_id", F.size("messages").cast("long").alias("n_messages"), rows.alias("n_rows"), pieces.alias("pieces"))
    laid = laid.withColumn("lengths", F.transform("pieces", lambda p: F.octet_length(p["text"]).cast("long"))).withColumn("starts", _starts(F.col("lengths")))
    marked = F.filter(F.arrays_zip(F.col("pieces.loss").alias("loss"), F.col("starts").alias("start"), F.col("lengths").alias("bytes")), lambda z: z["loss"])
    return laid.select(
        "conv_id",
        F.array_join("pieces.text", "").alias("formatted"),
        F.transform(marked, lambda z: F.struct(z["start"].alias("start"), z["bytes"].alias("bytes"))).alias("loss_spans"),
        "n_messages",
        "n_rows",
    )


def read_turns(formatted: Column) -> Column:
    """The rows (role, text) that a formatted text was made of."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    # Nothing follows the last end mark.
    return F.flatten(
        F.transform(
            F.slice(parts, F.lit(1), F.size(parts) - 1),
            lambda m: F.transform(
                F.split(F.regexp_replace(m, r"^[^\n]*\n", ""), r"<\|im_sep\|>"),
                lambda t: F.struct(
                    _unescape_role(F.substring(F.substring_index(m, "\n", 1), len(START) + 1, 2147483647)).alias("role"),
                    unescape(t).alias("text"),
                ),
            ),
        )
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """The assistant's texts under the loss mask, one after the other, nothing between."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted texts finds: counts and digests per conversation."""
    read = formatted.select("conv_id", "n_messages", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("rows"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_messages",
    )
