"""Row-wise null accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_count(cols: list[str]) -> Column:
    """Number of null values among ``cols`` in the row (0 for no columns)."""
    if not cols:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols])


def null_name_list(cols: list[str]) -> Column:
    """Array of the names of the null columns, in column order."""
    return F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]),
                    lambda x: x.isNotNull())
