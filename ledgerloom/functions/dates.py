"""Date tokens in text, from a fixed list of written forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

# Month names; the first three letters are kept.
_MONTH = (
    "(?:(jan)(?:uary)?|(feb)(?:ruary)?|(mar)(?:ch)?|(apr)(?:il)?|(may)|(jun)e?|(jul)y?|(aug)(?:ust)?|(sep)t?(?:ember)?|"
    "(oct)(?:ober)?|(nov)(?:ember)?|(dec)(?:ember)?)"
)
# The groups of a month name: only one of them is filled.
_NAME_GROUPS = 12
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_NUM_END = r"(?!\d)"

# Supported forms: year first; numeric with the month first; day month year; month day year.
ISO = rf"(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_NUM_END}"
NUMERIC = rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_NUM_END}"
# Years of two digits: 69 to 99 are of the last century.  Only in tokens, not looked for in running text.
_SHORT = rf"(\d{{1,2}})[-/.](\d{{1,2}})[-/.]"
SHORT_OLD, SHORT_NEW = rf"{_SHORT}(69|[7-9]\d){_NUM_END}", rf"{_SHORT}([0-6]\d){_NUM_END}"
_TIME = r"(?:(?:T|[ ,]+)\d{1,2}:\d{2}(?::\d{2})?(?: ?[ap]m)?Z?)?"
DAY_FIRST = rf"{_DAY}[ ,-]*{_MONTH}\.?[ ,-]*(\d{{4}}){_NUM_END}"
MONTH_FIRST = rf"{_MONTH}\.?[ -]*{_DAY}[ ,-]+(\d{{4}}){_NUM_END}"

ANY_DATE = rf"(?i)(?<![\dA-Za-z])(?:{ISO}|{NUMERIC}|{DAY_FIRST}|{MONTH_FIRST})"


def _groups(first: int) -> str:
    return "".join(f"${i}" for i in range(first, first + _NAME_GROUPS))


def _read(token: Column, pattern: str, parts: str, form: str) -> Column:
    """Rewrite a token of one form as ``=year-month-day`` and read that.

    The leading mark keeps tokens of other forms from being read by accident.
    """
    rewritten = F.regexp_replace(token, "(?i)^" + pattern, f"={parts}")
    # Reading fails slowly: only what was rewritten is read.
    return bind(rewritten, lambda r: F.when(r.startswith("="), F.try_to_date(r, f"'='yyyy-{form}-d")))


def parse_date(token: Column, whole: bool = True) -> Column:
    """Date of a token in one of the supported forms; anything else is NULL.

    Ambiguous numeric dates are month-first; a first number over 12 is the day.
    With ``whole`` the token must hold nothing but the date and maybe a time of day.
    """
    end = _TIME + r"\s*$" if whole else ".*$"

    def read(t: Column) -> Column:
        found = F.coalesce(
            _read(t, ISO + end, "$1-$2-$3", "M"),
            _read(t, NUMERIC + end, "$3-$1-$2", "M"),
            _read(t, NUMERIC + end, "$3-$2-$1", "M"),
            *[
                _read(t, short + end, f"{century}$3-{md}", "M")
                for md in ("$1-$2", "$2-$1")
                for short, century in ((SHORT_NEW, 20), (SHORT_OLD, 19))
            ],
            _read(t, DAY_FIRST + end, f"${2 + _NAME_GROUPS}-{_groups(2)}-$1", "MMM"),
            _read(t, MONTH_FIRST + end, f"${2 + _NAME_GROUPS}-{_groups(1)}-${1 + _NAME_GROUPS}", "MMM"),
        )
        return F.when(t.rlike(r"\d"), found)

    return bind(token, read)


def first_date(text: Column) -> Column:
    """Date of the first date-like token in the text."""
    return parse_date(F.regexp_extract(text, ANY_DATE, 0), whole=False)
