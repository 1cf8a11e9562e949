"""Lookup indexes as a long table (index_name, kind, entity_id, property, value_type, value), and joins against it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import HeaderField
from weftgraph.session import stored

ENTRY = ("index_name", "kind", "entity_id", "property", "value_type", "value")
UNRESOLVED = -1
_KINDS = ("node_index", "relationship_index")
_MODES = ("exact", "fulltext")
_KEY = re.compile(r"^batch_import\.(node|relationship)_index\.(.+)")


@dataclass(frozen=True)
class IndexSpec:
    """A configured index: its kind, name, mode and, maybe, a file of entries."""

    kind: str
    name: str
    mode: str = "exact"
    file: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in _KINDS:
            raise ValueError(f"index kind {self.kind}: one of {', '.join(_KINDS)}")
        if self.mode not in _MODES:
            raise ValueError(f"index type {self.mode}: one of {', '.join(_MODES)}")

    @classmethod
    def from_entry(cls, key: str, value: str) -> IndexSpec | None:
        """Of a configuration entry, or None where the key names no index."""
        m = _KEY.match(key)
        if not m:
            return None
        mode, _, file = value.partition(":")
        return cls(f"{m.group(1)}_index", m.group(2), mode, file or None)

    @property
    def key(self) -> str:
        return f"batch_import.{self.kind}.{self.name}"

    @property
    def value(self) -> str:
        return f"{self.mode}:{self.file}" if self.file else self.mode


def check_names(specs: list[IndexSpec]) -> dict[str, IndexSpec]:
    """Specs by name; a name for a node and a relationship index at once is an error."""
    named: dict[str, IndexSpec] = {}
    for s in specs:
        if s.name in named and named[s.name].kind != s.kind:
            raise ValueError(f"index {s.name} is configured for nodes and for relationships")
        named[s.name] = s
    return named


def text_of(value: Column, kind: str) -> Column:
    """A typed value as an index holds it. Arrays are JSON, so that different arrays are different texts whatever parted them."""
    return F.to_json(value.cast("array<string>")) if kind.endswith("_ARRAY") else value.cast("string")


def entries(rows: DataFrame, fields: list[HeaderField], kind: str, offset: int = 0, specs: dict[str, IndexSpec] | None = None) -> DataFrame:
    """Entries of the header's indexed columns from ``offset`` on, for rows (id, props). Absent values have none. An index that isn't configured is an error."""
    made = []
    for f in fields[offset:]:
        if not f.index or not f.is_property:
            continue
        if specs is not None and f.index not in specs:
            raise ValueError(f"index {f.index} of column {f.name} isn't configured")
        value = F.col("props")[f.name]
        made.append(F.struct(F.lit(f.index).alias("index_name"), F.lit(kind).alias("kind"), F.lit(f.name).alias("property"), F.lit(f.type).alias("value_type"), text_of(value, f.type).alias("value")))
    if not made:
        return rows.select("id").where("false").select(F.lit("").alias("index_name"), F.lit("").alias("kind"), F.col("id").alias("entity_id"), *[F.lit("").alias(c) for c in ENTRY[3:]])
    return rows.select(F.col("id").alias("entity_id"), F.explode(F.array(*made)).alias("e")).where("e.value is not null").select("e.index_name", "e.kind", "entity_id", "e.property", "e.value_type", "e.value")


def file_entries(rows: DataFrame, fields: list[HeaderField], spec: IndexSpec) -> DataFrame:
    """Entries of an index file: the first cell is the entity's id, every other column a property."""
    named = [HeaderField(f.position, f.name, f.type, spec.name) for f in fields]
    return entries(rows, named, spec.kind, 1)


def distinct_entries(index: DataFrame) -> DataFrame:
    """Every (value, id) of a property once."""
    return index.dropDuplicates(list(ENTRY))


def index_get(index: DataFrame, name: str, prop: str, value: str) -> DataFrame:
    """Ids of one key. On a stored graph, which is partitioned by index_name, only that index is read."""
    return index.where((F.col("index_name") == name) & (F.col("property") == prop) & (F.col("value") == value)).select("entity_id")


def hit_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("index_name", "property", "value").agg(F.count("*").alias("hits"))


def lookup_keys(index: DataFrame, name: str, prop: str) -> DataFrame:
    """(key, n, one): per value of a property how many entities have it, and the lowest of them. Stored, so that joins know its real size before they are planned."""
    wanted = index.where((F.col("index_name") == name) & (F.col("property") == prop))
    return stored(wanted.groupBy(F.col("value").alias("key")).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("one")), "keys")


def lookup(rows: DataFrame, column: str, keys: DataFrame, name: str, prop: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the one id whose ``prop`` has the value in ``column``: -1 for none and for null, an error for more than one.

    ``keys`` (see ``lookup_keys``) has one row per value, so a value never multiplies rows; whether it is broadcast Catalyst decides by its size.
    """
    key, n, one = f"_{out}_key", f"_{out}_n", f"_{out}_id"
    joined = rows.join(keys.toDF(key, n, one), F.col(column) == F.col(key), "left")
    several = F.raise_error(F.concat(F.lit(f"index {name} has several entries of {prop} "), F.col(column)))
    return joined.withColumn(out, F.when(F.col(n) > 1, several.cast("bigint")).otherwise(F.coalesce(one, F.lit(UNRESOLVED)))).drop(key, n, one)


def tokens(index: DataFrame) -> DataFrame:
    """(kind, entity_id, property, token, index_name): the different words of each entry, for full-text indexes, which are searched by word."""
    words = F.explode(_words(F.col("value"))).alias("token")
    return index.select("kind", "entity_id", "property", words, "index_name").where("token <> ''").distinct()


def search(found: DataFrame, name: str, prop: str, words: str) -> DataFrame:
    """Ids of the entries of a full-text index that hold every word of ``words``; none where there is no word. ``found`` is a graph's ``tokens``."""
    wanted = [w for w in found.sparkSession.range(1).select(_words(F.lit(words))).first()[0] if w]
    hits = found.where((F.col("index_name") == name) & (F.col("property") == prop) & F.col("token").isin(wanted))
    return hits.groupBy("entity_id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted)).select("entity_id")


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def fulltext_tokens(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token): the different words of each text in lower case; what ``tokens`` does for entries. Null and blank texts have none."""
    return table.select(F.col(key), F.explode(_words(F.col(text))).alias("token")).where("token <> ''")
