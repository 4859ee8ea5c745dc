"""Names a value within a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for each row: a lambda's variable isn't inlined, as a projected column may be."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
