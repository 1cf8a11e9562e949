"""Predicates on single cells that several operators share, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_FORM = r"\A[+-]?[0-9]+\z"
FLOAT_FORM = r"\A[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"
NAME_FORM = r"\A\p{Lu}[\p{L}'\-]*( \p{Lu}[\p{L}'\-]*)+\z"
DAY_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def is_blank(cell: Column) -> Column:
    """Null or empty."""
    return cell.isNull() | (cell == "")


def as_int(cell: Column) -> Column:
    """The 32-bit number a cell holds, else null: an optional sign and digits, nothing else."""
    return F.when(cell.rlike(INT_FORM), cell.try_cast("bigint").try_cast("int"))


def as_long(cell: Column) -> Column:
    """The 64-bit number a cell holds, else null."""
    return F.when(cell.rlike(INT_FORM), cell.try_cast("bigint"))


def as_day(cell: Column) -> Column:
    """The date of a yyyy-mm-dd cell, else null; there is no year 0."""
    return F.when(cell.rlike(DAY_FORM) & ~cell.startswith("0000"), cell.try_cast("date"))


def is_key(cell: Column) -> Column:
    """Whether a cell can name a record; never null.

    Not a key: null, empty, only spaces, a control character, U+FFFD, or an odd number of quotes.
    """
    quotes = F.length(cell) - F.length(F.replace(cell, F.lit('"'), F.lit("")))
    good = (F.trim(cell) != "") & ~cell.rlike(r"[\x00-\x1f\x7f\x{fffd}]") & (~cell.contains('"') | (quotes % 2 == 0))
    return F.coalesce(good, F.lit(False))
