"""Structured Streaming: files that arrive in a folder are appended as typed rows to a table, or as nodes to a graph and its indexes (an extension of repeated loads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions.convert import convert
from weftgraph.operators.graph import Graph, load
from weftgraph.operators.index import IndexSpec
from weftgraph.operators.rows import cell_at
from weftgraph.schema import HeaderField
from weftgraph.sources.cells import CellFile, split_plain


def _stream_cells(spark: SparkSession, folder: str, delim: str) -> DataFrame:
    return spark.readStream.text(folder).select(split_plain(F.col("value"), delim).alias("cells")).where(F.exists("cells", lambda c: c != ""))


def stream_rows(spark: SparkSession, folder: str, fields: list[HeaderField], delim: str = "\t") -> DataFrame:
    """Typed rows of plain files without header that arrive in ``folder``; blank lines are left out, a bad cell fails the query."""
    cells = _stream_cells(spark, folder, delim).withColumn("line_no", F.lit(0).cast("bigint"))
    return cells.select(*[convert(cell_at(f.position), f, F.col("line_no")).alias(f.name) for f in fields])


def append_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to the Parquet table ``target``, exactly once, and stop."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def append_nodes(spark: SparkSession, folder: str, fields: list[HeaderField], specs: list[IndexSpec], target: str, checkpoint: str, delim: str = "\t") -> StreamingQuery:
    """Load what has arrived in ``folder`` (plain files without header) as nodes of the graph ``target``, with their index entries, and stop.

    Each micro-batch is one load, named by its number: a batch that is run again after a failure finds its load there and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        cells = batch.select(F.lit(1).alias("file_no"), (F.monotonically_increasing_id() + 1).alias("line_no"), "cells")
        earlier = Graph.read(spark, target) if Graph.exists(spark, target) else None
        load(spark, [CellFile(folder, fields, cells)], [], specs, earlier=earlier)[0].write(target, keep=True, name=f"batch{number}")

    return _stream_cells(spark, folder, delim).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()
