"""Strict conversion of cells to the types of a header, as Column expressions. A cell that can't be converted fails the job when it is read."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.cells import INT_FORM
from weftgraph.schema import SCALARS, HeaderField

_WHOLE = {"ID", "INT", "LONG", "BYTE", "SHORT"}


def as_scalar(cell: Column, kind: str) -> Column:
    """The value of a cell that isn't null, or null where it has none. Whole numbers take no blanks; any text but ``true`` is false; of a text one CHAR is left."""
    if kind == "STRING":
        return cell
    if kind == "BOOLEAN":
        return F.lower(cell) == "true"
    if kind == "CHAR":
        return F.nullif(F.substring(cell, 1, 1), F.lit(""))
    if kind in _WHOLE:
        return F.when(cell.rlike(INT_FORM), cell.try_cast(SCALARS[kind]))  # a cast alone would trim blanks
    return cell.try_cast(SCALARS[kind])


def drop_trailing_empties(parts: Column) -> Column:
    """Parts without the empty ones at the end; a text without separator keeps its one part, empty or not."""
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), last))


def split_array(cell: Column, separator: str = ",", regex: bool = False) -> Column:
    return drop_trailing_empties(F.split(cell, separator if regex else re.escape(separator)))


def split_labels(cell: Column) -> Column:
    """Labels of a cell: parted by commas with blanks around them; a cell of blanks is one empty label."""
    return drop_trailing_empties(F.split(F.regexp_replace(cell, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"\s*,\s*"))


def value_of(cell: Column, field: HeaderField, separator: str = ",", regex: bool = False) -> tuple[Column, Column]:
    """(value, whether a cell that isn't null fails to convert)."""
    if field.type == "LABEL":
        return split_labels(cell), F.lit(False)
    if field.type.endswith("_ARRAY"):
        kind = field.type.removesuffix("_ARRAY")
        parts = split_array(cell, separator, regex)
        values = F.transform(parts, lambda p: as_scalar(p, kind))
        bad = F.lit(False) if kind in ("STRING", "BOOLEAN") else F.exists(values, lambda v: v.isNull())
        return values, bad
    value = as_scalar(cell, field.type)
    return value, value.isNull()


def message(cell: Column, field: HeaderField, row: Column) -> Column:
    return F.concat(
        F.lit("Error converting value row "), row.cast("string"), F.lit(f" column {field} value "), cell, F.lit(f" error: not a value of type {field.type}")
    )


def convert(cell: Column, field: HeaderField, row: Column, separator: str = ",", regex: bool = False) -> Column:
    """The typed value of a cell; null stays null, a bad cell raises with its row (data rows count from 1), column, type and value."""
    value, bad = value_of(cell, field, separator, regex)
    error = F.raise_error(message(cell, field, row))
    if field.type in SCALARS:  # the value stands once in the expression: its generated code stays small enough to be compiled
        return F.coalesce(value, F.when(cell.isNotNull(), error.cast(field.spark_type)))
    return F.when(cell.isNull(), F.lit(None)).when(bad, error).otherwise(value).cast(field.spark_type)


def fails(cell: Column, field: HeaderField, separator: str = ",", regex: bool = False) -> Column:
    """Whether ``convert`` would raise."""
    return cell.isNotNull() & value_of(cell, field, separator, regex)[1]
