"""Minimum-cost error parse of delimited records.

A record is read by a grammar of cells: a quoted cell runs to the quote that stands before a delimiter or the end (a backslash takes
the next character, a doubled quote is one quote), any other cell holds no quote. The parse may insert or delete quotes and
delimiters at a cost of one each. The states of the dynamic program are (token, cell number, mode); costs are settled in layers 0, 1,
2, ... Layer 0 is the grammar itself and has one path at most: of records without quotes it is a split, done by built-in expressions, of others a
plain scan. Only records that it can't accept go on to the layers above. Cost 0 with type-valid cells loads; otherwise the edits, or the cells of a
wrong type, are the reason. Cells of tables that are loaded already have been read at cost 0: the same test of types and keys judges them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.cells import FLOAT_FORM, as_int, as_long, is_key

_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_BAD_KEY = re.compile(r"[\x00-\x1f\x7f�]")
_BITS = {"int": 32, "long": 64}
_START, _PLAIN, _QUOTED, _ESCAPE, _CLOSED = _MODES = range(5)
_TEXT, _QUOTE, _BACKSLASH, _DELIM = range(4)
_KEEP, _DELETE, _PUT_QUOTE, _PUT_DELIM = range(4)
_EDITS = {(_DELETE, _QUOTE): "delete quote", (_DELETE, _DELIM): "delete delimiter", _PUT_QUOTE: "insert quote", _PUT_DELIM: "insert delimiter"}


class Parse(NamedTuple):
    """``cells``: decoded, None where the cost isn't 0. ``rule``: None, ``quoting``, ``count``, ``value``, ``null`` or ``header``."""

    cells: list[str] | None
    cost: int
    rule: str | None
    edits: list[str]


class Layout(NamedTuple):
    names: tuple[str, ...]
    types: tuple[str, ...]
    counts: frozenset[int]
    typed: tuple[tuple[int, str], ...]
    keys: int


@lru_cache(maxsize=4096)
def layout_of(series: str, header: str, delim: str) -> Layout:
    """What a file's header asks of its records. Only nodes and nodes2 may leave off the last cell; in rels the first two cells are keys."""
    parts = [(c.split(":") + [""])[:2] for c in header.split(delim)]
    types = tuple("int" if n == "age" else (t.lower() or "string") for n, t in parts)
    n = len(parts)
    return Layout(
        tuple(p[0] for p in parts),
        types,
        frozenset({n, n - 1} if series in ("nodes", "nodes2") else {n}),
        tuple((i, t) for i, t in enumerate(types) if t in ("int", "long", "double", "float")),
        2 if series == "rels" else 0,
    )


def fits_int(text: str, bits: int = 32) -> bool:
    if not _INT.fullmatch(text):
        return False
    digits = text.lstrip("+-").lstrip("0") or "0"
    if len(digits) > 19:
        return False
    value = -int(digits) if text[0] == "-" else int(digits)
    return -(1 << (bits - 1)) <= value < 1 << (bits - 1)


def fits(text: str, kind: str) -> bool:
    """Whether a cell that isn't empty converts to ``kind``."""
    if kind in _BITS:
        return fits_int(text, _BITS[kind])
    return _FLOAT.fullmatch(text) is not None if kind in ("double", "float") else True


def key_ok(text: str) -> bool:
    return bool(text.strip(" ")) and not _BAD_KEY.search(text) and text.count('"') % 2 == 0


@lru_cache(maxsize=64)
def _scanner(delim: str) -> re.Pattern:
    d = re.escape(delim)
    return re.compile(rf'(?:"((?:[^"\\]|\\.|"")*+)"|([^"{d}]*+))(?:({d})|\Z)', re.DOTALL)


_TAKEN = re.compile(r'\\(.)|""', re.DOTALL)


def scan(record: str, delim: str) -> list[str] | None:
    """Layer 0: the decoded cells, or None where the grammar doesn't hold."""
    if '"' not in record:
        return record.split(delim)
    cells, at, cell = [], 0, _scanner(delim)
    while m := cell.match(record, at):
        quoted = m.group(1)
        cells.append(m.group(2) if quoted is None else _TAKEN.sub(lambda e: e.group(1) or '"', quoted))
        if m.group(3) is None:
            return cells
        at = m.end()
    return None


@lru_cache(maxsize=64)
def _tokens(delim: str) -> re.Pattern:
    d = re.escape(delim)
    return re.compile(rf'(")|(\\)|({d})|[^"\\{d}]+', re.DOTALL)


def cheapest(record: str, delim: str, counts: frozenset[int]) -> tuple[int, list[str]]:
    """The lowest cost at which the record has one of ``counts`` cells, and the edits of one such parse with their offsets.

    A state takes one byte, its way back; a layer is what the one before reaches with one edit, and all that these reach without. Memory: five bytes for each
    token and cell, and a layer's states.
    """
    kinds, offset = bytearray(), array("q")
    for m in _tokens(delim).finditer(record):
        kinds.append(m.lastindex or _TEXT)
        offset.append(m.start())
    offset.append(len(record))
    n, most = len(kinds), max(counts)
    way = bytearray((n + 1) * most * 5)  # 0: not reached; else 1 + 5 * move + the mode it was reached from
    ends = {(n * most + k - 1) * 5 + mode for k in counts if k for mode in (_START, _PLAIN, _CLOSED)}
    here, ahead = array("q", [_START, 1]), array("q")  # pairs of a state and its way back
    cost = 0
    while True:
        while here:
            back = here.pop()
            s = here.pop()
            if way[s]:
                continue
            way[s] = back
            if s in ends:
                return cost, _edits(way, s, kinds, offset, most)
            at, mode = divmod(s, 5)
            i, k = divmod(at, most)
            kind = kinds[i] if i < n else None
            stay, on = 1 + mode, (at + most) * 5  # on: the same cell at the next token
            if mode == _ESCAPE:  # the backslash takes whatever comes next once the edits are done
                if kind is not None:
                    here.extend((on + _QUOTED, stay))
                    if kind in (_QUOTE, _DELIM):
                        ahead.extend((on + _ESCAPE, stay + 5 * _DELETE))
                ahead.extend((at * 5 + _QUOTED, stay + 5 * _PUT_QUOTE))
            elif mode == _QUOTED:
                if kind is not None:
                    here.extend((on + (_CLOSED if kind == _QUOTE else _ESCAPE if kind == _BACKSLASH else _QUOTED), stay))
                    if kind == _QUOTE:
                        ahead.extend((on + _QUOTED, stay + 5 * _DELETE))
                ahead.extend((at * 5 + _CLOSED, stay + 5 * _PUT_QUOTE))
            else:
                if kind == _DELIM:
                    if k + 1 < most:
                        here.extend((on + 5 + _START, stay))
                    ahead.extend((on + mode, stay + 5 * _DELETE))
                elif kind == _QUOTE:
                    if mode != _PLAIN:  # at the beginning it opens, after a closing quote the two are one quote
                        here.extend((on + _QUOTED, stay))
                    ahead.extend((on + mode, stay + 5 * _DELETE))
                elif kind is not None and mode != _CLOSED:
                    here.extend((on + _PLAIN, stay))
                if mode != _PLAIN:
                    ahead.extend((at * 5 + _QUOTED, stay + 5 * _PUT_QUOTE))
                if k + 1 < most:
                    ahead.extend(((at + 1) * 5 + _START, stay + 5 * _PUT_DELIM))
        here, ahead, cost = ahead, array("q"), cost + 1
        if not here:
            raise AssertionError("a parse always exists: every quote and delimiter can be deleted, every delimiter inserted")


def _edits(way: bytearray, s: int, kinds: bytearray, offset: array, most: int) -> list[str]:
    edits = []
    while s != _START:
        at, mode = divmod(s, 5)
        move, was = divmod(way[s] - 1, 5)
        if move == _PUT_DELIM or (move == _KEEP and mode == _START):
            at -= 1
        if move in (_KEEP, _DELETE):
            at -= most
        if move != _KEEP:
            i = at // most
            edits.append(f"{_EDITS[(move, kinds[i]) if move == _DELETE else move]}@{offset[i]}")
        s = at * 5 + was
    return edits[::-1]


def parse_record(line: str | None, series: str | None, header: str | None, delim: str | None) -> Parse:
    """Parse one record. A null record has the rule ``null``, a record of a file without header ``header``; one CR at the end is dropped."""
    if line is None:
        return Parse(None, 0, "null", ["null record"])
    if header is None or not delim:
        return Parse(None, 0, "header", ["no header"])
    want = layout_of(series or "", header, delim)
    record = line[:-1] if line.endswith("\r") else line
    cells = scan(record, delim)
    if cells is None or len(cells) not in want.counts:
        cost, edits = cheapest(record, delim, want.counts)
        return Parse(None, cost, "quoting" if cells is None else "count", edits)
    wrong = [f"{want.names[i]} is no {t}" for i, t in want.typed if i < len(cells) and cells[i] and not fits(cells[i], t)]
    wrong += [f"cell {i} is no key" for i in range(want.keys) if not key_ok(cells[i])]
    return Parse(cells, 0, "value" if wrong else None, wrong)


PARSED = "line_id bigint, file_no int, line_no bigint, series string, cost int, rule string, edits array<string>, fields array<string>, kinds array<string>, cells array<string>"


def _parse_batches(batches: Iterator[pa.RecordBatch], failed: bool, loaded: bool) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.string(), texts, texts, texts, texts]
    names = [c.split(" ")[0] for c in PARSED.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        columns = [batch.column(c).to_pylist() for c in ("line_id", "file_no", "line_no", "series", "header", "delim", "line")]
        for line_id, file_no, line_no, series, header, delim, line in zip(*columns, strict=True):
            p = parse_record(line, series, header, delim)
            if p.rule is None:
                if loaded:
                    want = layout_of(series, header, delim)
                    rows.append((line_id, file_no, line_no, series, 0, None, p.edits, want.names, want.types, p.cells))
            elif failed:
                rows.append((line_id, file_no, line_no, series, p.cost, p.rule, p.edits, None, None, p.cells))
        parts = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(parts, kinds, strict=True)], names=names)


def _is_bad(cell: Column, kind: Column | str) -> Column:
    """Whether a cell that isn't null doesn't convert to ``kind``; an empty one always does."""
    bad = {"int": as_int(cell).isNull(), "long": as_long(cell).isNull(), "double": ~cell.rlike(FLOAT_FORM), "float": ~cell.rlike(FLOAT_FORM)}
    if isinstance(kind, str):
        return (cell != "") & bad[kind] if kind in bad else F.lit(False)
    return (cell != "") & reduce(lambda w, k: w.when(kind == k, bad[k]), bad, F.when(F.lit(False), F.lit(False))).otherwise(False)


def _reasons(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")


def parse_records(lines: DataFrame, files: DataFrame, failed: bool = True, loaded: bool = True) -> DataFrame:
    """Parse ``lines`` (line_id, file_no, line_no, line) by the headers of ``files`` (file_no, series, header, delim).

    One row per record, see ``PARSED``; ``failed`` and ``loaded`` choose which come out. The headers join by file_no; Catalyst broadcasts
    them where their size is under its limit and else shuffles, with adaptive skew handling for a file that holds most lines. Records without a quote
    whose count of cells is right don't leave the JVM. Other columns of either input are ignored. Empty tables give no rows.
    """
    parts = F.transform(F.split("header", F.concat(F.lit(r"\Q"), "delim", F.lit(r"\E")), -1), lambda h: F.split(h, ":"))
    kind = lambda p: F.when(F.get(p, F.lit(0)) == "age", "int").otherwise(F.coalesce(F.nullif(F.lower(F.get(p, F.lit(1))), F.lit("")), F.lit("string")))
    heads = files.select("file_no", "series", "header", "delim", F.transform(parts, lambda p: F.get(p, F.lit(0))).alias("fields"), F.transform(parts, kind).alias("kinds"))
    tested = F.filter(F.transform("kinds", lambda k, i: F.struct(i.alias("at"), k.alias("kind"))), lambda x: x["kind"].isin("int", "long", "double", "float"))
    heads = heads.withColumn("tested", tested)  # once a file: most columns are texts
    joined = lines.select("line_id", "file_no", "line_no", "line").join(heads, "file_no", "left")
    record = F.when(F.col("line").endswith("\r"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    plain = (F.col("delim") != "") & ~F.col("line").contains('"') & F.col("header").isNotNull()
    short = F.col("series").isin("nodes", "nodes2") & (F.size("cells") == F.size("fields") - 1)
    once = F.monotonically_increasing_id() >= 0  # true of every row; keeps Catalyst from copying what is worked out into each expression that reads it
    cut = joined.withColumn("cells", F.when(plain & once, F.split(record, F.concat(F.lit(r"\Q"), "delim", F.lit(r"\E")), -1)))
    simple = F.coalesce((F.size("cells") == F.size("fields")) | short, F.lit(False)) & F.col("cells").isNotNull()
    values = F.transform("tested", lambda t: F.when(_is_bad(F.get("cells", t["at"]), t["kind"]), F.concat(F.get("fields", t["at"]), F.lit(" is no "), t["kind"])))
    keys = _reasons(*[F.when((F.col("series") == "rels") & ~is_key(F.get("cells", F.lit(i))), F.lit(f"cell {i} is no key")) for i in (0, 1)])
    easy = cut.where(simple).withColumn("edits", F.when(once, F.concat(F.array_compact(values), keys))).withColumn("rule", F.when(F.size("edits") > 0, "value"))
    if not (failed and loaded):
        easy = easy.where(F.col("rule").isNotNull() if failed else F.col("rule").isNull() if loaded else F.lit(False))
    ok = F.col("rule").isNull()
    easy = easy.select("line_id", "file_no", "line_no", "series", F.lit(0).alias("cost"), "rule", "edits", F.when(ok, F.col("fields")).alias("fields"), F.when(ok, F.col("kinds")).alias("kinds"), "cells")
    hard = cut.where(~simple).select("line_id", "file_no", "line_no", "series", "header", "delim", "line")
    return easy.unionByName(hard.mapInArrow(lambda batches: _parse_batches(batches, failed, loaded), PARSED))


@dataclass(frozen=True)
class CellTable:
    """Records of a table whose cells are read already. ``fields``: name and type of a column's header cell, by column; ``checked``: the columns whose cells must convert; ``keys``: those that must be keys."""

    tbl: str
    table: DataFrame
    row_key: str
    fields: dict[str, tuple[str, str]]
    checked: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    def reasons(self) -> list[tuple[str, Column]]:
        """Per column that is tested the reason why its cell fails, null where it doesn't."""
        values = [(c, F.when(_is_bad(F.col(f"`{c}`"), self.fields[c][1]), F.lit(f"{c} is no {self.fields[c][1]}"))) for c in self.checked]
        return values + [(c, F.when(~is_key(F.col(f"`{c}`")), F.lit(f"{c} is no key"))) for c in self.keys]

    def fails(self) -> Column:
        return reduce(lambda x, y: x | y, [r.isNotNull() for _, r in self.reasons()], F.lit(False))


JUDGED = ("tbl", "row_key", "series", "file_no", "line_no", "rule", "cost", "edits", "cells")


def failed_records(lines: DataFrame, files: DataFrame, tables: list[CellTable]) -> DataFrame:
    """Every record that fails, of raw lines and of tables alike: see ``JUDGED``. ``rule`` and ``edits`` are the reason; ``cells`` the cells, of tables those that fail, null where a line can't be cut into cells."""
    out = parse_records(lines, files, loaded=False).select(F.lit("raw_lines").alias("tbl"), F.col("line_id").alias("row_key"), *JUDGED[2:])
    for t in tables:
        faults = F.filter(F.array(*[F.struct(F.col(f"`{c}`").alias("cell"), r.alias("reason")) for c, r in t.reasons()]), lambda x: x["reason"].isNotNull())
        made = {"tbl": F.lit(t.tbl), "row_key": F.col(t.row_key).cast("bigint"), "series": F.lit(t.tbl), "file_no": F.lit(None).cast("int"), "line_no": F.lit(None).cast("bigint"), "rule": F.lit("value"), "cost": F.lit(0)}
        made |= {"edits": F.transform(faults, lambda x: x["reason"]), "cells": F.transform(faults, lambda x: x["cell"])}
        out = out.unionByName(t.table.where(t.fails()).select(*[made[c].alias(c) for c in JUDGED]))
    return out


def loaded_records(lines: DataFrame, files: DataFrame, tables: list[CellTable], keep: tuple[str, ...] = ()) -> DataFrame:
    """Every other record as typed cells (see ``typed_cells``): tbl, row_key, series, file_no, line_no, cells, and the columns ``keep`` of tables that have them, null elsewhere.

    A cell of a table that isn't tested and isn't of its type keeps its text and has no number.
    """
    columns = ["tbl", "row_key", "series", "file_no", "line_no", "cells"]
    parts = [typed_cells(parse_records(lines, files, failed=False)).withColumn("tbl", F.lit("raw_lines")).withColumnRenamed("line_id", "row_key").select(*columns)]
    for t in tables:
        cells = [_typed_cell(F.col(f"`{c}`"), name, kind) for c, (name, kind) in t.fields.items()]
        more = [c for c in keep if c in t.table.columns]
        parts.append(t.table.where(~t.fails()).select(F.lit(t.tbl).alias("tbl"), F.col(t.row_key).cast("bigint").alias("row_key"), F.lit(t.tbl).alias("series"), *more, F.array(*cells).alias("cells")))
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return every.select(*columns[:-1], *[c for c in keep if c in every.columns], "cells")


def _typed_cell(cell: Column, name: str, kind: str) -> Column:
    whole = as_long(cell) if kind in ("int", "long") else F.lit(None).cast("bigint")
    real = F.when(cell.rlike(FLOAT_FORM), cell.try_cast("double")) if kind in ("double", "float") else F.lit(None).cast("double")
    return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("kind"), F.nullif(cell, F.lit("")).alias("text"), whole.alias("whole"), real.alias("real"))


def typed_cells(parsed: DataFrame) -> DataFrame:
    """Loaded records as typed cells: one struct per cell with its field, type, text and, where the type asks for one, its number. An empty cell is null."""
    return parsed.where(F.col("rule").isNull()).select(
        "line_id",
        "file_no",
        "line_no",
        "series",
        F.transform(
            F.sequence(F.lit(0), F.size("cells") - 1),
            lambda i: F.struct(
                F.get("fields", i).alias("field"),
                F.get("kinds", i).alias("kind"),
                F.nullif(F.get("cells", i), F.lit("")).alias("text"),
                F.when(F.get("kinds", i).isin("int", "long"), F.get("cells", i).try_cast("bigint")).alias("whole"),
                F.when(F.get("kinds", i).isin("double", "float"), F.get("cells", i).try_cast("double")).alias("real"),
            ),
        ).alias("cells"),
    )
