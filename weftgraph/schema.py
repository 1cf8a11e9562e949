"""Typed headers: ``name[:type[:index]]`` cells, the type names, and the Spark types they load as."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The type names of a header cell and the Spark type of each.
SCALARS: dict[str, T.DataType] = {
    "ID": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "INT": T.IntegerType(),
    "LONG": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BYTE": T.ByteType(),
    "SHORT": T.ShortType(),
    "CHAR": T.StringType(),
    "STRING": T.StringType(),
}
_ELEMENTS = ("BOOLEAN", "INT", "LONG", "DOUBLE", "FLOAT", "BYTE", "SHORT", "CHAR", "STRING")
TYPES: dict[str, T.DataType] = {**SCALARS, "LABEL": T.ArrayType(T.StringType()), **{f"{e}_ARRAY": T.ArrayType(SCALARS[e]) for e in _ELEMENTS}}


class HeaderError(ValueError):
    """A header cell that can't be understood."""


@dataclass(frozen=True)
class HeaderField:
    """One header cell. ``position`` counts from 0; ``index`` is the name of a lookup index or None."""

    position: int
    name: str
    type: str = "STRING"
    index: str | None = None

    @property
    def spark_type(self) -> T.DataType:
        return TYPES[self.type]

    @property
    def is_label(self) -> bool:
        return self.type == "LABEL"

    @property
    def is_property(self) -> bool:
        return self.type not in ("ID", "LABEL")

    def __str__(self) -> str:
        return f"{self.position}. {self.name} type: {self.type}"


def type_named(text: str | None) -> str:
    """The canonical type name; missing or empty is STRING, case doesn't matter, any other name is an error."""
    if not text:
        return "STRING"
    name = text.upper()
    if name not in TYPES:
        raise HeaderError(f"Unknown Type {text}")
    return name


def parse_header(cells: list[str]) -> list[HeaderField]:
    """Fields of a header's cells. Empty names are allowed (``:label``)."""
    fields = []
    for position, cell in enumerate(cells):
        name, kind, index = (cell.split(":", 2) + ["", ""])[:3]
        fields.append(HeaderField(position, name, type_named(kind), index.split(":")[0] or None))
    return fields


def header_of(line: str, delim: str = "\t") -> list[HeaderField]:
    return parse_header(line.rstrip("\r\n").split(delim))


def label_field(fields: list[HeaderField]) -> HeaderField | None:
    """The last LABEL column is the one that counts."""
    return next((f for f in reversed(fields) if f.is_label), None)


def has_explicit_ids(fields: list[HeaderField]) -> bool:
    return bool(fields) and fields[0].type == "ID"


def property_fields(fields: list[HeaderField], offset: int = 0) -> dict[str, list[HeaderField]]:
    """Property columns from ``offset`` on, by name in column order. A name that stands twice has several columns: the last filled one wins."""
    named: dict[str, list[HeaderField]] = {}
    for f in fields[offset:]:
        if f.is_property:
            named.setdefault(f.name, []).append(f)
    return named


def to_struct(fields: list[HeaderField], offset: int = 0) -> T.StructType:
    return T.StructType([T.StructField(n, fs[-1].spark_type) for n, fs in property_fields(fields, offset).items()])
