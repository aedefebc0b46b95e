"""Name an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Spark shares repeated subexpressions only in generated code; inside
    higher-order functions each mention would be computed again.
    """
    return F.get(F.transform(F.array(value), use), 0)
