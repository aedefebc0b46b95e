"""Column helpers over JSON objects held as ``map<string, variant>``.

The map keeps the source order of the top-level keys; each value keeps its JSON
type, which the loosely typed extraction results need.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

OBJECT = "map<string,variant>"
LIST = "array<variant>"
# Characters that Python-style stripping removes.
BLANKS = " \t\n\r\f\u000b"


def as_object(text: Column) -> Column:
    """Top-level object of a JSON text; NULL for anything that is not an object."""
    return F.from_json(text, OBJECT)


def key(obj: Column, name: str) -> Column:
    return F.try_element_at(obj, F.lit(name))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_list(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("ARRAY"), F.lit(False))


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value).startswith("OBJECT"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(kind(value) == "STRING", F.lit(False))


def is_boolean(value: Column) -> Column:
    return F.coalesce(kind(value) == "BOOLEAN", F.lit(False))


def is_number(value: Column) -> Column:
    name = kind(value)
    return F.coalesce((name == "BIGINT") | (name == "DOUBLE") | name.startswith("DECIMAL"), F.lit(False))


def text_of(value: Column) -> Column:
    """Scalars as plain text, lists and objects as JSON text, null as NULL."""
    return F.try_variant_get(value, "$", "string")


def number_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def elements(value: Column) -> Column:
    return F.try_variant_get(value, "$", LIST)


def members(value: Column) -> Column:
    return F.try_variant_get(value, "$", OBJECT)


def present(value: Column) -> Column:
    """False for a missing value, null, 0, false and anything empty."""

    def check(v: Column) -> Column:
        text = F.to_json(v)
        return ~(text.isin("null", '""', "false", "[]", "{}") | (is_number(v) & (number_of(v) == 0)))

    return F.coalesce(bind(value, check), F.lit(False))


def first_present(*values: Column) -> Column:
    """First value that is present; when none is, the last one as it stands."""

    def pick(listed: Column) -> Column:
        return F.coalesce(F.get(F.filter(listed, present), 0), F.get(listed, len(values) - 1))

    return bind(F.array(*values), pick)


def filled_text(value: Column) -> Column:
    """The value if it is a string with a non-blank character, else NULL."""
    return bind(
        value, lambda v: F.when(is_string(v) & (F.btrim(text_of(v), F.lit(BLANKS)) != ""), text_of(v))
    )
