"""Loading nodes, relationships and indexes, and keeping them as a directory of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import AbstractContextManager, nullcontext
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.convert import as_scalar, convert
from weftgraph.operators import index as ix
from weftgraph.operators.ids import assign_ids, next_id, number_by_line
from weftgraph.operators.rows import prop_names, stop_at_blank, typed_rows, union_rows
from weftgraph.schema import HeaderField, has_explicit_ids
from weftgraph.session import small_table
from weftgraph.sources.cells import CellFile

REL_OFFSET = 3
INDEX_SCHEMA = "kind string, entity_id bigint, property string, value_type string, value string, index_name string"
TOKEN_SCHEMA = "kind string, entity_id bigint, property string, token string, index_name string"
_NODE_ROWS = "file_no int, line_no bigint, id bigint, labels array<string>, cell_type string, props struct<>, own boolean"
_REL_ROWS = "file_no int, line_no bigint, start bigint, end bigint, type string, props struct<>"


def _cut(file: CellFile) -> DataFrame:
    return file.rows if file.kept is not None else stop_at_blank(file.rows, len(file.fields))


def node_rows(files: list[CellFile], separator: str = ",", regex: bool = False, clash: str = "raise") -> DataFrame:
    """Typed rows of node files up to each file's first blank row, with ``own``: whether the file has an ID column. At least one file."""
    parts = [typed_rows(_cut(f), f.fields, 0, separator, regex).withColumn("own", F.lit(has_explicit_ids(f.fields))) for f in files]
    return union_rows(parts, clash)


def check_ids(rows: DataFrame, earlier: DataFrame | None = None) -> int:
    """The id after the largest one of ``rows`` and of ``earlier`` nodes. An id that stands twice is an error.

    Two aggregates over ids alone; one row comes to the driver.
    """
    ids = rows.select("id") if earlier is None else rows.select("id").unionByName(earlier.select("id"))
    per = ids.groupBy("id").agg(F.count("*").alias("n"))
    top = per.agg(F.max("id").alias("most"), F.min(F.when(F.col("n") > 1, F.col("id"))).alias("twice")).first()
    if top.twice is not None:
        raise ValueError(f"several nodes with id {top.twice}")
    return 0 if top.most is None else top.most + 1


def with_ids(rows: DataFrame, files: list[CellFile], base: int = 0, earlier: DataFrame | None = None) -> DataFrame:
    """Nodes (id, labels, props, file_no) in file order. Files with an ID column keep their ids, the rows of other files are numbered from ``base`` or the id
    after the largest one given, whichever is more, so that no two nodes share an id. An id that is given twice, or that an ``earlier`` node has, is an error.

    Where the files' row counts are known an id is the file's first one plus the line number: no shuffle and no sort.
    """
    columns = ["id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "props", "file_no"]
    implicit = [f for f in files if not has_explicit_ids(f.fields)]
    if len(implicit) < len(files):
        base = max(base, check_ids(rows.where("own") if implicit else rows, earlier))
    if not implicit:
        return rows.select(*columns)
    if all(f.kept is not None for f in implicit):
        starts, at = [], base
        for number, n in sorted(x for f in implicit for x in f.kept.items()):
            starts.append((number, at - 1))
            at += n
        first = small_table(rows.sparkSession, starts, "file_no int, _first bigint")
        return rows.join(first, "file_no", "left").withColumn("id", F.coalesce("id", F.col("_first") + F.col("line_no"))).select(*columns)
    numbered = assign_ids(rows.where(~F.col("own")).drop("id"), ["file_no", "line_no"], base).select(*columns)
    return numbered.unionByName(rows.where("own").select(*columns)) if len(implicit) < len(files) else numbered


def literal_id(text: Column, what: str, asked: Column | None = None) -> Column:
    """A cell as an id; null and anything but a whole number abort the load, except in rows that aren't ``asked`` for."""
    error = F.raise_error(F.concat(F.lit(f"{what} is no id: "), F.coalesce(text, F.lit("null")))).cast("bigint")
    return F.coalesce(as_scalar(text, "LONG"), error if asked is None else F.when(asked, error))


def _typed_text(field: HeaderField, separator: str, regex: bool) -> Column:
    """A cell as the text that an index holds of its typed value: ``01`` of an int is ``1``. Null and empty cells are null, a cell of another type aborts."""
    cell = F.nullif(F.get("cells", F.lit(field.position)), F.lit(""))
    return cell if field.type in ("STRING", "ID") else ix.text_of(convert(cell, field, F.col("line_no"), separator, regex), field.type)


def with_endpoints(cells: DataFrame, fields: list[HeaderField], index: DataFrame | None, separator: str = ",", regex: bool = False) -> DataFrame:
    """``cells`` with start and end ids: looked up where the header names an index (unless the type is ID), else literal; -1 is unresolved.

    What is looked up is the value that the header's type makes of a cell, not its text.
    """
    out = cells
    keys: dict[tuple[str, str], DataFrame] = {}
    for f, name in zip(fields[:2], ("start", "end"), strict=True):
        text = _typed_text(f, separator, regex)
        if f.index and f.type != "ID":
            if index is None:
                raise ValueError(f"index {f.index} isn't configured")
            if (f.index, f.name) not in keys:
                keys[f.index, f.name] = ix.lookup_keys(index, f.index, f.name)
            out = ix.lookup(out.withColumn(f"_{name}", text), f"_{name}", keys[f.index, f.name], f.index, f.name, name).drop(f"_{name}")
        else:
            # rows beyond a file's end have no cells: whenever Catalyst looks at them, they don't abort
            out = out.withColumn(f"_{name}", text).withColumn(name, literal_id(F.col(f"_{name}"), name, F.col("cells").isNotNull())).drop(f"_{name}")
    return out


def endpoint_rows(cells: DataFrame, fields: list[HeaderField], index: DataFrame | None, found: bool = True, separator: str = ",", regex: bool = False) -> DataFrame:
    """The rows of ``cells`` whose two endpoints are (``found``) or aren't both nodes that the index or a literal id names: a semi or an anti join that keeps the cells."""
    keep = is_resolved() if found else ~is_resolved()
    return with_endpoints(cells, fields, index, separator, regex).where(keep).drop("start", "end")


def resolved_rows(cells: DataFrame, fields: list[HeaderField], index: DataFrame | None, separator: str = ",", regex: bool = False, cut: bool = False) -> DataFrame:
    """(file_no, line_no, start, end, type, props) of all rows up to the blank one, unresolved ones with -1. Cells convert before rows are dropped.

    ``cut``: the rows end before the blank one already.
    """
    placed = with_endpoints(cells if cut else stop_at_blank(cells, len(fields)), fields, index, separator, regex)
    typed = typed_rows(placed, fields, REL_OFFSET, separator, regex, keep=("start", "end"))
    return typed.select("file_no", "line_no", "start", "end", F.col("cell_type").alias("type"), "props")


def is_resolved() -> Column:
    return (F.col("start") != ix.UNRESOLVED) & (F.col("end") != ix.UNRESOLVED)


def relationships_of(rows: DataFrame, base: int = 0, total: int | None = None, unique: bool = False) -> DataFrame:
    """(id, start, end, type, props) of the resolved rows, ids in file order after the skips. A resolved row without type aborts.

    ``total``: the number of rows, or somewhat more, where line numbers count them; ``unique``: no line number stands twice in a file.
    """
    kept = rows.where(is_resolved())
    kept = assign_ids(kept, ["file_no", "line_no"], base) if total is None else number_by_line(kept, total, base, unique=unique)
    kind = F.coalesce("type", F.raise_error(F.concat(F.lit("relationship without type, row "), F.col("line_no").cast("string"))))
    return kept.select("id", "start", "end", kind.alias("type"), "props")


def import_counts(rows: DataFrame) -> DataFrame:
    """(imported, skipped) of relationship rows."""
    return rows.agg(F.count_if(is_resolved()).alias("imported"), F.count_if(~is_resolved()).alias("skipped"))


def dangling(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships whose start or end is no node's id: an opt-in check, literal ids are loaded unchecked."""
    ids = nodes.select(F.col("id").alias("_node"))
    ends = rels.select("*", F.explode(F.array("start", "end")).alias("_end"))
    return ends.join(ids, F.col("_end") == F.col("_node"), "left_anti").drop("_end").dropDuplicates(["id"])


Phase = Callable[[str], AbstractContextManager]


def _silent(_: str) -> AbstractContextManager:
    return nullcontext()


@dataclass
class Graph:
    """nodes (id, labels, props), relationships (id, start, end, type, props), index entries, and the names of the full-text indexes.

    A stored graph is a folder of loads, each a folder ``load-*`` of Parquet tables that appears there at once, by one rename. Stored graphs have
    ``tokens`` too: the words of the entries of full-text indexes.
    """

    nodes: DataFrame
    relationships: DataFrame
    index: DataFrame
    fulltext: tuple[str, ...] = ()
    tokens: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Graph:
        tables = [spark.read.option("mergeSchema", "true").parquet(f"{path}/load-*/{t}") for t in ("nodes", "relationships")]
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/load-*")
        loads = [str(x.getPath()) for x in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)]

        def every(table: str, schema: str) -> DataFrame:
            """Tables that are partitioned are read load by load: a table has one root."""
            return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(f"{load}/{table}") for load in loads])

        return cls(*tables, every("index", INDEX_SCHEMA), (), every("tokens", TOKEN_SCHEMA))

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def write(self, path: str, keep: bool = False, phase: Phase = _silent, name: str | None = None) -> None:
        """Write the tables beside the target and move them there when all are complete, so a failed load leaves the graph as it was.

        ``keep`` adds a load to those there are, in one rename; else the old graph stands aside until the new one is in place. ``phase`` surrounds the
        writing of each table. ``name``: of the load; with ``keep`` a load of that name that is there already stays, and nothing is written.
        """
        spark = self.nodes.sparkSession
        name = name or uuid.uuid4().hex
        if keep and self.exists(spark, f"{path.rstrip('/')}/load-{name}"):
            return
        beside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
        fresh = f"{beside}/load-{name}"
        for label, table in (("nodes", self.nodes), ("relationships", self.relationships)):
            with phase(label):
                (table if prop_names(table) else table.drop("props")).write.parquet(f"{fresh}/{label}")  # Parquet has no struct without fields
        with phase("index"):
            ix.distinct_entries(self.index).write.partitionBy("index_name").parquet(f"{fresh}/index")
            written = spark.read.schema(INDEX_SCHEMA).parquet(f"{fresh}/index").where(F.col("index_name").isin(list(self.fulltext)))
            ix.tokens(written).write.partitionBy("index_name").parquet(f"{fresh}/tokens")
        jvm = spark.sparkContext._jvm
        fs_path = jvm.org.apache.hadoop.fs.Path
        target, new, old = fs_path(path), fs_path(beside), fs_path(f"{beside}-old")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def move(source, to) -> None:
            if not fs.rename(source, to):
                raise OSError(f"{source} can't be moved to {to}")

        if keep and fs.exists(target):
            move(fs_path(fresh), fs_path(f"{path.rstrip('/')}/load-{name}"))
            fs.delete(new, True)
            return
        stood = fs.exists(target)
        if stood:
            move(target, old)
        try:
            move(new, target)
        except Exception:
            if stood:
                fs.rename(old, target)
            raise
        fs.delete(old, True)


def _numbers(file: CellFile, place: int) -> list[int]:
    return sorted(file.kept) if file.kept is not None else [place]


def known_rows(files: list[CellFile]) -> int | None:
    """Rows of all files before their blank ones, or None where they weren't counted."""
    return sum(sum(f.kept.values()) for f in files) if all(f.kept is not None for f in files) else None


def load(
    spark: SparkSession,
    node_files: list[CellFile],
    rel_files: list[CellFile],
    specs: list[ix.IndexSpec],
    index_files: dict[str, list[CellFile]] | None = None,
    earlier: Graph | None = None,
    separator: str = ",",
    regex: bool = False,
    clash: str = "raise",
) -> tuple[Graph, DataFrame]:
    """A graph of node files, relationship files and index files, and the counts (imported, skipped) of relationships.

    Nodes come first and fill their indexes, relationships look up there (and in ``earlier``, whose ids are continued), index files are added last.
    Without node files or without relationship files there are no nodes or no relationships.
    """
    named = ix.check_names(specs)
    rows = node_rows(node_files, separator, regex, clash) if node_files else spark.createDataFrame([], _NODE_ROWS)
    nodes = with_ids(rows, node_files, next_id(earlier.nodes) if earlier else 0, earlier.nodes if earlier else None)
    index = spark.createDataFrame([], INDEX_SCHEMA).select(*ix.ENTRY)
    for i, f in enumerate(node_files, 1):
        index = index.unionByName(ix.entries(nodes.where(F.col("file_no").isin(_numbers(f, i))), f.fields, "node_index", 0, named))
    probed = index.unionByName(earlier.index.select(*ix.ENTRY)) if earlier else index
    rows = [resolved_rows(f.rows, f.fields, probed, separator, regex, f.kept is not None) for f in rel_files]
    united = union_rows(rows, clash) if rows else spark.createDataFrame([], _REL_ROWS)
    rels = relationships_of(united, next_id(earlier.relationships) if earlier else 0, known_rows(rel_files), True)
    marked = [f for f in rel_files if any(c.index for c in f.fields[REL_OFFSET:])]
    for f in marked:
        index = index.unionByName(ix.entries(rels, [c for c in f.fields if c.position < REL_OFFSET or c.name in prop_names(rels)], "relationship_index", REL_OFFSET, named))
    for name, files in (index_files or {}).items():
        for f in files:
            typed = typed_rows(_cut(f), f.fields, 1, separator, regex, keep=("cells",))
            placed = typed.select(literal_id(F.get("cells", F.lit(0)), "entity", F.col("cells").isNotNull()).alias("id"), "props")
            index = index.unionByName(ix.file_entries(placed, f.fields, named[name]))
    fulltext = tuple(sorted(n for n, s in named.items() if s.mode == "fulltext"))
    return Graph(nodes.drop("file_no"), rels, index, fulltext), import_counts(united)
