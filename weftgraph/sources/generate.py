"""Synthetic graphs of any size, made in parallel from a range of node numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hexes(*parts) -> F.Column:
    return F.substring(F.md5(F.concat_ws("/", *parts)), 1, 8)


def random_graph(spark: SparkSession, nodes: int, most_rels: int, types: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(Node, Rels, Property, Label, Counter) and (Start, Ende, Type, Property, Counter).

    Each node has 1 to ``most_rels`` relationships and one more, with uniform endpoints; their type goes round. Draws are hashes of the numbers, so that a task that runs again makes the same rows.
    """
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) / float(1 << 40)
    base = spark.range(nodes).select(F.col("id").alias("Node"), (F.floor(draw(F.lit("n"), "id") * most_rels) + 1).cast("int").alias("Rels"))
    table = base.select("Node", "Rels", _hexes("Node", F.lit("p")).alias("Property"), F.element_at(F.array(*map(F.lit, types)), F.pmod("Node", F.lit(len(types))).cast("int") + 1).alias("Label"), F.col("Node").cast("int").alias("Counter"))
    each = base.select("Node", F.explode(F.sequence(F.col("Rels"), F.lit(0), F.lit(-1))).alias("rel"))
    ends = [F.floor(draw(F.lit(w), "Node", "rel") * nodes).cast("bigint") for w in ("s", "e")]
    rels = each.select(ends[0].alias("Start"), ends[1].alias("Ende"), _type_of("rel", types), _hexes("Node", "rel").alias("Property"), F.col("rel").cast("bigint").alias("Counter"))
    return table, rels


def _type_of(rel: str, types: list[str]):
    return F.element_at(F.array(*map(F.lit, types)), F.pmod(F.col(rel), F.lit(len(types))).cast("int") + 1).alias("Type")


def sorted_graph(spark: SparkSession, nodes: int, most_rels: int, types: list[str], seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """As ``random_graph``, but each relationship joins its node with one of the same or a higher number, in either direction, and all five node cells are written."""
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40)) / float(1 << 40)
    table, _ = random_graph(spark, nodes, most_rels, types, seed)
    each = table.select("Node", F.explode(F.sequence(F.col("Rels"), F.lit(0), F.lit(-1))).alias("rel"))
    other = (F.col("Node") + F.floor(draw(F.lit("t"), "Node", "rel") * (nodes - F.col("Node")))).cast("bigint")
    both = each.withColumn("other", other).withColumn("turned", draw(F.lit("d"), "Node", "rel") < 0.5)
    rels = both.select(
        F.when(F.col("turned"), F.col("other")).otherwise(F.col("Node")).alias("Start"),
        F.when(F.col("turned"), F.col("Node")).otherwise(F.col("other")).alias("Ende"),
        _type_of("rel", types),
        _hexes("Node", "rel").alias("Property"),
        F.col("rel").cast("bigint").alias("Counter"),
    )
    return table, rels


def ring_graph(spark: SparkSession, nodes: int, offsets: list[int], kind: str = "ONE") -> tuple[DataFrame, DataFrame]:
    """Nodes (id, blocked true, age 42) and one relationship (id, start, end, type, weight 10) per node and offset, to (node + offset) mod nodes."""
    table = spark.range(nodes).select("id", F.lit(True).alias("blocked"), F.lit(42).cast("bigint").alias("age"))
    each = spark.range(nodes).select(F.col("id").alias("start"), F.posexplode(F.array(*map(F.lit, offsets))).alias("k", "offset"))
    rels = each.select(
        (F.col("start") * len(offsets) + F.col("k")).alias("id"), "start", F.pmod(F.col("start") + F.col("offset"), F.lit(nodes)).alias("end"), F.lit(kind).alias("type"), F.lit(10.0).cast("float").alias("weight")
    )
    return table, rels


def write_files(nodes: DataFrame, rels: DataFrame, folder: str) -> None:
    """Tab-delimited part files with typed headers, ``nodes`` and ``rels``."""
    named = nodes.toDF("Node", "Rels", "Property", "Label:label", "Counter:int")
    named.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/nodes")
    rels.toDF("Start", "Ende", "Type", "Property", "Counter:long").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/rels")
