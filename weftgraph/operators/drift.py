"""Schemas that drift between files: a catalogue of column lifespans, a log of changes, and one table of all files.

Headers are the footers: exploded into (series, file, field, type) and put into order of arrival. Runs of files that hold a field of one type are
its lifespans (lag and islands per series, field and type); where they start and end is the log. A start and an ending in the same file are one renamed field
if the values say so. Lifespans and renamings make the alias table, of which the casts of the one table come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.cells import FLOAT_FORM, as_int, as_long
from weftgraph.operators.error_parse import parse_records
from weftgraph.session import small_table, stored

SAME_FORM, SAME_STOCK, SLACK = 0.5, 0.4, 0.05
_LIFE = ["series", "field", "life"]


def header_cells(files: DataFrame) -> DataFrame:
    """(series, file_no, seq, position, field, type): the header cells of each file, files of a series in order of arrival.

    Files that arrive at the same time stand in the order of file_no; files without header are none. One row per file and cell: the size is that of
    the metadata, not of the records.
    """
    order = Window.partitionBy("series").orderBy("arrived_at", "file_no")
    cells = F.posexplode(F.split("header", F.concat(F.lit(r"\Q"), "delim", F.lit(r"\E")), -1)).alias("position", "cell")
    parts = files.where("header is not null").withColumn("seq", F.row_number().over(order)).select("series", "file_no", "seq", cells).withColumn("p", F.split("cell", ":"))
    kind = F.coalesce(F.nullif(F.lower(F.get("p", F.lit(1))), F.lit("")), F.lit("string")).alias("type")
    return parts.select("series", "file_no", "seq", "position", F.get("p", F.lit(0)).alias("field"), kind)


def catalogue(cells: DataFrame) -> DataFrame:
    """(series, file_no, seq, field, type, positions): the fields of each file. A name that stands twice in a header is one field; its types are joined."""
    per = F.sort_array(F.collect_list(F.struct("position", "type"))).alias("cells")
    fields = cells.groupBy("series", "file_no", "seq", "field").agg(per)
    kind = F.array_join(F.array_sort(F.array_distinct("cells.type")), ",").alias("type")
    return fields.select("series", "file_no", "seq", "field", kind, F.col("cells.position").alias("positions"))


def lifespans(cat: DataFrame) -> DataFrame:
    """(series, field, type, first_seq, last_seq): unbroken runs of one type of one field, from lag and islands."""
    run = Window.partitionBy("series", "field", "type").orderBy("seq")
    new = F.coalesce(F.lag("seq").over(run) != F.col("seq") - 1, F.lit(True))
    marked = cat.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(run))
    return marked.groupBy("series", "field", "type", "span").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).drop("span")


def lives(spans: DataFrame) -> DataFrame:
    """``lifespans`` with ``life``, which numbers the unbroken runs of a field whatever its type, ``before``, the type of the span right before, and whether the run ``ends``."""
    run = Window.partitionBy("series", "field").orderBy("first_seq")
    goes_on = F.coalesce(F.lag("last_seq").over(run) == F.col("first_seq") - 1, F.lit(False))
    marked = spans.withColumns({"before": F.when(goes_on, F.lag("type").over(run)), "ends": F.coalesce(F.lead("first_seq").over(run) != F.col("last_seq") + 1, F.lit(True))})
    return marked.withColumn("life", F.sum(F.col("before").isNull().cast("int")).over(run))


def change_log(living: DataFrame, cat: DataFrame) -> DataFrame:
    """(file_no, what, series, field, life, type): where a field starts (but with the first file), ends (the file that lacks it) and changes its type."""
    event = lambda what, seq, asked: F.when(asked, F.struct(F.lit(what).alias("what"), seq.alias("seq")))
    events = F.array_compact(
        F.array(
            event("added", F.col("first_seq"), F.col("before").isNull() & (F.col("first_seq") > 1)),
            event("retyped", F.col("first_seq"), F.col("before").isNotNull()),
            event("removed", F.col("last_seq") + 1, F.col("ends")),
        )
    )
    happened = living.select(*_LIFE, "type", F.explode(events).alias("e")).select(*_LIFE, "type", "e.*")
    return happened.join(cat.select("series", "seq", "file_no").distinct(), ["series", "seq"]).select("file_no", "what", *_LIFE, "type")


def _stock(asked: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(id, value, h0, h1): how often each value of the lives in ``asked`` (file_no, id, positions) stands in either half of the records."""
    per_file = asked.groupBy("file_no").agg(F.collect_list(F.struct("id", "positions")).alias("asked"))  # as many as a file has fields
    parsed = parse_records(lines.join(per_file.select("file_no"), "file_no", "left_semi"), files, failed=False).select("line_id", "file_no", "cells")
    half = F.pmod(F.xxhash64("line_id"), F.lit(2)).alias("half")
    each = parsed.join(per_file, "file_no").select("cells", half, F.explode("asked").alias("a")).select("cells", "half", "a.id", F.explode("a.positions").alias("at"))
    values = each.select("id", "half", F.explode(F.split(F.get("cells", F.col("at")), ",")).alias("value"), F.get("cells", F.col("at")).alias("cell")).where("cell <> ''")
    return values.groupBy("id", F.trim("value").alias("value")).agg(F.count_if(F.col("half") == 0).alias("h0"), F.count_if(F.col("half") == 1).alias("h1"))


def _overlaps(pairs: DataFrame, stock: DataFrame) -> DataFrame:
    """Per pair the share that the old and the new field's distributions of values and of their forms have in common, and each field's halves among themselves."""
    form = F.col("value")
    for pattern, mark in ((r"[\p{Lu}]", "A"), (r"[\p{Ll}]+", "a"), (r"[0-9]+", "9"), (r"\s+", " ")):
        form = F.regexp_replace(form, pattern, mark)
    totals = stock.groupBy("id").agg(F.sum("h0").alias("t0"), F.sum("h1").alias("t1"))
    sides = pairs.select("pair", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in ("old", "new")])).alias("s")).select("pair", "s.*").join(totals, "id")
    both = F.array(F.struct(F.lit("value").alias("what"), F.col("value").alias("v")), F.struct(F.lit("form").alias("what"), form.alias("v")))
    shares = {"half0": F.try_divide("h0", "t0"), "half1": F.try_divide("h1", "t1"), "all": F.try_divide(F.col("h0") + F.col("h1"), F.col("t0") + F.col("t1"))}
    parts = stock.join(sides, "id").select("pair", "side", F.explode(both).alias("b"), *[c.alias(n) for n, c in shares.items()]).select("pair", "side", "b.*", *shares)
    per = {f"{s}_{n}": F.sum(F.when(F.col("side") == s, F.col(n))) for s in ("old", "new") for n in shares}
    counted = parts.groupBy("pair", "what", "v").agg(*[c.alias(n) for n, c in per.items()])
    common = {"both": ("old_all", "new_all"), "old": ("old_half0", "old_half1"), "new": ("new_half0", "new_half1")}
    # a value that one side lacks isn't common to both; a half without any value says nothing
    least = {n: F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.least(x, y)) if n == "both" else F.least(x, y) for n, (x, y) in common.items()}
    return counted.groupBy("pair").agg(*[F.coalesce(F.sum(F.when(F.col("what") == w, c)), F.lit(0.0)).alias(f"{w}_{n}") for w in ("value", "form") for n, c in least.items()])


def renames(log: DataFrame, living: DataFrame, cat: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_no, series, old, old_life, was, new, new_life, type): one field ended and another began in the same file, and their values are alike.

    Alike: at least SAME_FORM of the distributions of value forms is in common, and of the values themselves SAME_STOCK of what two
    halves of one field have in common (stocks that hardly repeat, such as dates, are judged by form), over the whole lives of both. A field takes part
    in one renaming of a file; the best pair wins, then the best of the fields still free, until no pair is left. Fields without values aren't renamed.
    """
    side = lambda what, name, kind: log.where(F.col("what") == what).select("file_no", "series", F.col("field").alias(name), F.col("life").alias(f"{name}_life"), F.col("type").alias(kind), F.xxhash64(*_LIFE).alias(f"{name}_id"))
    met = side("removed", "old", "was").join(side("added", "new", "type"), ["file_no", "series"])
    # candidates: one row per pair of an ended and a begun field of one file
    candidates = stored(met.withColumn("pair", F.to_json(F.struct("file_no", "old", "new"))), "pairs")
    wanted = candidates.select("series", F.explode(F.array(*[F.struct(F.col(s).alias("field"), F.col(f"{s}_life").alias("life"), F.col(f"{s}_id").alias("id")) for s in ("old", "new")])).alias("s")).select("series", "s.*").distinct()
    spans = living.join(wanted, _LIFE).select("series", "field", "first_seq", "last_seq", "id")
    asked = cat.join(spans, ["series", "field"]).where(F.col("seq").between(F.col("first_seq"), F.col("last_seq"))).select("file_no", "id", "positions")
    stock = stored(_stock(stored(asked, "asked"), lines, files), "stock")
    enough = (F.col("form_both") >= SAME_FORM) & (F.col("value_both") >= SAME_STOCK * F.least("value_old", "value_new") - SLACK)
    judged = candidates.join(_overlaps(candidates, stock), "pair").where(enough)
    ranked = F.struct((F.col("value_both") + F.col("form_both")).alias("score"), "pair", "old", "old_life", "was", "new", "new_life", "type")
    listed = judged.groupBy("file_no", "series").agg(F.sort_array(F.collect_list(ranked), asc=False).alias("pairs"))  # as many as its changed fields make

    def take(taken: Column, p: Column) -> Column:
        free = ~F.exists(taken, lambda t: (t["old"] == p["old"]) | (t["new"] == p["new"]))
        return F.when(free, F.concat(taken, F.array(p))).otherwise(taken)

    kind = listed.schema["pairs"].dataType.simpleString()
    taken = F.aggregate("pairs", F.array().cast(kind), take)
    return listed.select("file_no", "series", F.explode(taken).alias("t")).select("file_no", "series", "t.old", "t.old_life", "t.was", "t.new", "t.new_life", "t.type")


def _read_headers(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue, its lives and the log, each stored: tables of the metadata's size."""
    cat = stored(catalogue(header_cells(files)), "catalogue")
    living = stored(lives(lifespans(cat)), "lives")
    return cat, living, stored(change_log(living, cat), "log")


def schema_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(file_no, field_name, change_kind) of each file against the one of its series that arrived just before it.

    change_kind: added, removed, retyped, renamed (new name; neither added nor removed, but retyped as well if the type differs). First files have no
    changes; files without header are no files. Index names and the order of columns don't count.
    """
    cat, living, log = _read_headers(files)
    moved = renames(log, living, cat, lines, files)
    entry = lambda kind, field, counts: F.struct(F.lit(kind).alias("change_kind"), F.col(field).alias("field_name"), F.lit(counts).alias("counts"))
    of_moved = F.array_compact(F.array(entry("added", "new", False), entry("removed", "old", False), entry("renamed", "new", True), F.when(F.col("was") != F.col("type"), entry("retyped", "new", True))))
    every = log.select("file_no", F.col("what").alias("change_kind"), F.col("field").alias("field_name"), F.lit(True).alias("counts")).unionByName(moved.select("file_no", F.explode(of_moved).alias("m")).select("file_no", "m.*"))
    return every.groupBy("file_no", "field_name", "change_kind").agg(F.min("counts").alias("counts")).where("counts").select("file_no", "field_name", "change_kind")


def _common_type(types: set[str]) -> str:
    """The type that holds all of ``types``. A list and a single text are a list."""
    if types <= {"byte", "short", "int"}:
        return "int"
    if types <= {"byte", "short", "int", "long", "id"}:
        return "bigint"
    if types <= {"byte", "short", "int", "long", "id", "float", "double"}:
        return "double"
    if types == {"boolean"}:
        return "boolean"
    return "array<string>" if any(t.endswith("_array") or t == "label" for t in types) else "string"


def alias_table(files: DataFrame, lines: DataFrame, fixed: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """((file_no, columns, listed): by position the column of a file's cells and whether they are lists; column -> Spark type). ``fixed`` sets the types of columns.

    Chains of renamings take the name they began with. Only renamings and the columns' types come to the driver: one row per renamed field, and one per
    column and type, of which the result's schema is made; the catalogue doesn't.
    """
    cells = header_cells(files)
    cat, living, log = _read_headers(files)
    came = {(r.series, r.new, r.new_life): (r.series, r.old, r.old_life) for r in renames(log, living, cat, lines, files).collect()}
    roots = []
    for life in came:
        at = life
        while at in came:
            at = came[at]
        roots.append((*life, at[1]))
    named = living.join(small_table(files.sparkSession, roots, "series string, field string, life bigint, root string"), _LIFE, "left").withColumn("col", F.coalesce("root", "field"))
    types: dict[str, set[str]] = {}
    for r in named.select("col", F.explode(F.split("type", ",")).alias("type")).distinct().collect():
        types.setdefault(r.col, set()).add(r.type)
    spans = named.select("series", "field", "first_seq", "last_seq", "col")
    placed = cells.join(spans, ["series", "field"]).where(F.col("seq").between(F.col("first_seq"), F.col("last_seq")))
    per = placed.groupBy("file_no").agg(F.sort_array(F.collect_list(F.struct("position", "col", F.col("type").endswith("_array").alias("listed")))).alias("c"))
    return stored(per.select("file_no", F.col("c.col").alias("columns"), F.col("c.listed").alias("listed")), "aliases"), {c: fixed.get(c) or _common_type(t) for c, t in sorted(types.items())}


def _cast(cell: Column, kind: str) -> Column:
    """A text as ``kind``, null where it isn't one: numbers have no blanks around them."""
    if kind == "array<string>":
        return F.split(cell, ",")
    if kind == "boolean":
        return F.lower(cell) == "true"
    if kind in ("int", "bigint"):
        return as_int(cell) if kind == "int" else as_long(cell)
    if kind in ("double", "float"):
        return F.when(cell.rlike(FLOAT_FORM), cell.try_cast(kind))
    return cell.try_cast(kind) if kind != "string" else cell


def _lost(cell: Column, kind: str) -> Column:
    """Whether a text has no value as ``kind``, or loses digits: a whole number that a double can't hold."""
    gone = cell.isNotNull() & _cast(cell, kind).isNull()
    return gone | F.coalesce(F.abs(as_long(cell)) > (1 << 53), F.lit(False)) if kind == "double" else gone


def _own_columns(loaded: dict[str, tuple[DataFrame, dict[str, str]]], types: dict[str, str]) -> dict[str, str]:
    """column -> Spark type of the columns that only ``loaded`` tables have. Tables that differ in a column's type give it as text."""
    own: dict[str, str] = {}
    for table, columns in loaded.values():
        for source, column in columns.items():
            if column not in types:
                kind = table.schema[source].dataType.simpleString()
                own[column] = kind if own.get(column, kind) == kind else "string"
    return own


def one_table(
    files: DataFrame, lines: DataFrame, loaded: dict[str, tuple[DataFrame, dict[str, str]]], series: tuple[str, ...] = ("nodes", "nodes2"), fixed: dict[str, str] | None = None, unread: bool = False
) -> DataFrame:
    """Every loadable record of ``series`` and of the ``loaded`` tables under one set of columns.

    ``loaded`` maps a table's name to the table and its column aliases (column -> column of the result). Columns: origin (series or table), row_key (line_id or row_id), then
    the catalogue's columns by name, then those that only loaded tables have, null elsewhere. An empty cell is null; a column that a file lacks is null; a text whose column is a list elsewhere is split at commas, a
    list whose column is a text is joined by spaces. Of a field that stands twice in a header the last filled cell counts. A filled cell that isn't of its column's type is
    null; ``unread`` adds a column of that name with all such cells (column, text), and those of whole numbers that lose digits.
    """
    chosen = files.where(F.col("series").isin(*series))
    aliases, types = alias_table(chosen, lines, {"name": "string"} if fixed is None else fixed)
    parsed = parse_records(lines, chosen, failed=False).join(aliases, "file_no")
    cells = F.transform("cells", lambda x, i: F.struct(F.get("columns", i).alias("col"), F.get("listed", i).alias("listed"), F.nullif(x, F.lit("")).alias("text")))
    named = parsed.select(F.col("series").alias("origin"), F.col("line_id").alias("row_key"), cells.alias("cells"))

    def last_filled(column: str) -> Column:
        return F.try_element_at(F.filter("cells", lambda e: (e["col"] == column) & e["text"].isNotNull()), F.lit(-1))

    texts = named.select("origin", "row_key", *[last_filled(c).alias(f"_{i}") for i, c in enumerate(types)])
    of = {c: F.when(F.col(f"_{i}.listed") & F.lit(t == "string"), F.replace(F.col(f"_{i}.text"), F.lit(","), F.lit(" "))).otherwise(F.col(f"_{i}.text")) for i, (c, t) in enumerate(types.items())}
    own = _own_columns(loaded, types)

    def lost(texts: dict[str, Column]) -> list[Column]:
        found = [F.when(_lost(x, (types | own)[c]), F.struct(F.lit(c).alias("column"), x.alias("text"))) for c, x in texts.items()]
        none = F.array().cast("array<struct<column: string, text: string>>")
        return [(F.array_compact(F.array(*found)) if found else none).alias("unread")] if unread else []

    out = texts.select("origin", "row_key", *[_cast(of[c], t).alias(c) for c, t in types.items()], *[F.lit(None).cast(t).alias(c) for c, t in own.items()], *lost(of))
    for tbl, (table, columns) in loaded.items():
        into = {v: k for k, v in columns.items()}
        made, of = [], {}
        for c, t in (types | own).items():
            source = F.col(f"`{into[c]}`") if c in into else F.lit(None)
            if c in into and table.schema[into[c]].dataType.simpleString() == "string":
                of[c] = F.nullif(source, F.lit(""))
                made.append(_cast(of[c], t).alias(c))
            else:
                made.append(source.cast(t).alias(c))
        out = out.unionByName(table.select(F.lit(tbl).alias("origin"), F.col("row_id").alias("row_key"), *made, *lost(of)))
    return out
