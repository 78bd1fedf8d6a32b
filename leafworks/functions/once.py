"""Columns that are computed once, whatever is done with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``. A filter above a projection is pushed below it with the columns' expressions in place
    of their names, and so is done again for each use; a generator (of one row) stands in the way of that."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row: within lambdas an expression is done again for each element
    and each use, however often it stands there; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
