"""Name an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Using a costly column several times in plain form repeats its whole
    expression at every use, which multiplies with nesting until the generated
    code no longer compiles. A one-element array holds the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
