"""Small array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def join(parts: Column, delim: str) -> Column:
    """Parts joined by a delimiter; an empty array is an error."""
    return F.when(F.size(parts) == 0, F.raise_error(F.lit("nothing to join"))).otherwise(F.array_join(parts, delim))


def logical_size(numbers: Column) -> Column:
    """Length without the -1s at the end; of an array of nothing but -1 its whole length; 0 for null."""
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != -1, i + 1).otherwise(0)))
    return F.coalesce(F.nullif(last, F.lit(0)), F.when(numbers.isNotNull(), F.size(numbers)), F.lit(0))


def apart(column: Column) -> Column:
    """The same column by way of a higher-order function, which keeps the projection that it stands in out of whole-stage code.

    Whole-stage code puts a projection into one method, which the JVM doesn't compile beyond 8,000 bytes; outside it, a long projection is cut into methods that it does.
    """
    return F.get(F.transform(F.array(column), lambda x: x), F.lit(0))
