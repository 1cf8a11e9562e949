"""Sorting relationship files by their smaller, then their larger endpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import literal_id
from weftgraph.operators.ids import assign_ids
from weftgraph.sources.cells import numbered_lines


def endpoint_keys(lines: DataFrame, value: str = "value", delim: str = "\t") -> DataFrame:
    """``lines`` with lo and hi, the smaller and the larger of the first two cells. A cell that is no whole number aborts."""
    cells = F.split(F.col(value), delim, 4)
    ends = [literal_id(F.get(cells, F.lit(i)), w) for i, w in enumerate(("start", "end"))]
    return lines.withColumn("lo", F.least(*ends)).withColumn("hi", F.greatest(*ends))


def sort_relationships(lines: DataFrame) -> DataFrame:
    """Lines (line_no, value) without header in order of smaller endpoint, larger endpoint, line number: one range shuffle, no row is dropped."""
    return endpoint_keys(lines).orderBy("lo", "hi", "line_no")


def sorted_places(lines: DataFrame) -> DataFrame:
    """``endpoint_keys`` of lines with ``place``, the line's number (from 1) in the order of ``sort_relationships``."""
    return assign_ids(endpoint_keys(lines), ["lo", "hi", "line_no"], 1, "place")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in ``order``: a heap of n rows in each task, merged, and no full sort. Ties at the end are broken arbitrarily."""
    return rows.orderBy(*order).limit(n)


def sort_file(spark: SparkSession, source: str, target: str) -> None:
    """Sort a relationship file into the folder ``target``: part files in order, the first begins with the header."""
    lines = numbered_lines(spark, source)
    header = lines.where("line_no = 0").select(F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), "line_no", "value")
    body = endpoint_keys(lines.where("line_no > 0")).select("lo", "hi", "line_no", "value")
    header.unionByName(body).orderBy(F.col("lo").asc_nulls_first(), "hi", "line_no").select("value").write.mode("overwrite").text(target)
