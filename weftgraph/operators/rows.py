"""Cells to typed rows: stop rows, ragged rows, properties, labels, types and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.convert import convert, fails
from weftgraph.schema import HeaderError, HeaderField, has_explicit_ids, label_field, property_fields
from weftgraph.session import small_table

# Column names that the legacy reader takes for labels.
LEGACY_LABELS = ("type", "types", "label", "labels")


def cell_at(position: int, legacy: bool = False) -> Column:
    """A cell or null: missing and empty cells are absent, surplus cells aren't asked for. The legacy reader takes blank cells as absent too."""
    cell = F.get("cells", F.lit(position))
    return F.when(F.trim(cell) != "", cell) if legacy else F.nullif(cell, F.lit(""))


def stop_at_blank(cells: DataFrame, width: int) -> DataFrame:
    """Rows before the first one of their file that has no filled cell among the first ``width``; a blank row ends its file.

    Runs one aggregate, whose result has a row per file with a blank row; without any the rows stay as they are, else they meet it in a broadcast join and aren't shuffled.
    """
    blank = F.coalesce(*[cell_at(i) for i in range(max(width, 1))]).isNull()  # looks no further than the first filled cell
    found = cells.where(blank).groupBy("file_no").agg(F.min("line_no").alias("stop")).collect()
    if not found:
        return cells
    stops = small_table(cells.sparkSession, [(r.file_no, r.stop) for r in found], "file_no int, stop bigint")
    before = F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))
    # the guard keeps rows after the stop from being converted whatever order Catalyst picks
    return cells.join(stops, "file_no", "left").where(before).withColumn("cells", F.when(before, F.col("cells"))).drop("stop")


def legacy_fields(fields: list[HeaderField]) -> list[HeaderField]:
    return [HeaderField(f.position, f.name, "LABEL" if f.name.lower() in LEGACY_LABELS else f.type, f.index) for f in fields]


def typed_rows(cells: DataFrame, fields: list[HeaderField], offset: int = 0, separator: str = ",", regex: bool = False, legacy: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(file_no, line_no, id, labels, cell_type, props): props is a struct of the typed properties from column ``offset`` on.

    id: the first column where it has the type ID, where an empty cell raises, else null. labels: of the last LABEL column, null if it has no value. cell_type: the first label or, without
    LABEL column, the third cell. Of a property whose name stands twice the last filled column counts. A cell that doesn't
    convert raises; null props mean absent values. The legacy reader keeps id and label columns among the properties.
    ``keep``: columns of ``cells`` that are carried along.
    """
    if legacy:
        fields = legacy_fields(fields)
    row = F.col("line_no")
    # cells first, in a projection of their own, so that no conversion repeats how a cell is found
    texts = cells.select("file_no", "line_no", *keep, F.col("cells").isNotNull().alias("_has"), *[cell_at(i, legacy).alias(f"_c{i}") for i in range(max(len(fields), 3))])
    typed = {f.position: convert(F.col(f"_c{f.position}"), f, row, separator, regex) for f in fields}
    groups = property_fields(fields, offset)
    if legacy:
        groups = {f.name: [f] for f in fields[offset:]}
    props = [F.coalesce(*[typed[f.position] for f in reversed(fs)]).alias(n) for n, fs in groups.items()]
    label = label_field(fields)
    labels = typed[label.position] if label else F.lit(None).cast("array<string>")
    third = F.get(labels, F.lit(0)) if label else (F.col("_c2") if len(fields) > 2 else F.lit(None).cast("string"))
    number = F.lit(None).cast("bigint")
    if has_explicit_ids(fields):  # rows beyond a file's end have no cells and don't abort
        error = F.raise_error(F.concat(F.lit("no id in row "), row.cast("string"))).cast("bigint")
        number = typed[0] if legacy else F.coalesce(typed[0], F.when(F.col("_has"), error))
    return texts.select("file_no", "line_no", *keep, number.alias("id"), labels.alias("labels"), third.alias("cell_type"), (F.struct(*props) if props else F.lit(None).cast("struct<>")).alias("props"))


def conversion_errors(cells: DataFrame, fields: list[HeaderField], separator: str = ",", regex: bool = False) -> DataFrame:
    """(file_no, line_no, position, name, type, value): one row per cell that would abort a load."""
    found = [
        F.when(fails(cell_at(f.position), f, separator, regex), F.struct(F.lit(f.position).alias("position"), F.lit(f.name).alias("name"), F.lit(f.type).alias("type"), cell_at(f.position).alias("value")))
        for f in fields
    ]
    return cells.select("file_no", "line_no", F.explode(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e")).select("file_no", "line_no", "e.*")


def prop_names(rows: DataFrame) -> list[str]:
    kind = rows.schema["props"].dataType if "props" in rows.columns else None
    return kind.names if isinstance(kind, T.StructType) else []


def property_count(rows: DataFrame) -> Column:
    """How many properties of a row have a value."""
    names = prop_names(rows)
    return sum((F.col("props")[n].isNotNull().cast("int") for n in names), F.lit(0))


def as_map(rows: DataFrame) -> Column:
    """The properties of a row that have a value, as a map from name to text (see ``text_of``); an empty map where there are none."""
    names = prop_names(rows)
    if not names:
        return F.create_map().cast("map<string, string>")
    kinds = {n: rows.schema["props"].dataType[n].dataType for n in names}
    texts = [F.to_json(F.col("props")[n]) if isinstance(kinds[n], T.ArrayType) else F.col("props")[n].cast("string") for n in names]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*texts)), lambda k, v: v.isNotNull())


def union_rows(frames: list[DataFrame], clash: str = "raise") -> DataFrame:
    """Rows of several files in one frame: properties that a file lacks are null.

    One property with different types in two files is an error; ``clash="variant"`` makes it a VARIANT that keeps each file's type.
    """
    types: dict[str, set[str]] = {}
    for f in frames:
        for n in prop_names(f):
            types.setdefault(n, set()).add(f.schema["props"].dataType[n].dataType.simpleString())
    mixed = sorted(n for n, t in types.items() if len(t) > 1)
    if mixed and clash != "variant":
        raise HeaderError("different types in different files: " + ", ".join(f"{n} ({', '.join(sorted(types[n]))})" for n in mixed))
    out = None
    for f in frames:
        have = prop_names(f)
        props = []
        for n, t in types.items():
            if n not in have:
                props.append(F.lit(None).cast("variant" if n in mixed else next(iter(t))).alias(n))
            else:
                props.append((F.col("props")[n].cast("variant") if n in mixed else F.col("props")[n]).alias(n))
        g = f.withColumn("props", F.struct(*props) if props else F.col("props"))
        out = g if out is None else out.unionByName(g)
    return out
