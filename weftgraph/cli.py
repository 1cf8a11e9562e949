"""``python -m weftgraph.cli [x.properties] graph nodes rels (kind name type [file])*``: load files into a graph directory."""

from __future__ import annotations

import logging
import sys
import time

from pyspark.sql import SparkSession

from weftgraph.config import ConfigError, LoadConfig
from weftgraph.operators.graph import Graph, known_rows, load
from weftgraph.report import Phases
from weftgraph.sources.cells import CellFile, read_cells, usable_paths

log = logging.getLogger("weftgraph")
USAGE = "usage: [x.properties] graph nodes[,nodes...] rels[,rels...] (node_index|relationship_index name exact|fulltext [file])*"


def run(spark: SparkSession, config: LoadConfig) -> dict[str, int | float | dict]:
    """Load by ``config`` and write the graph; returns the counts, the seconds, and rows and seconds by phase."""
    began = time.monotonic()
    report = Phases(spark)

    def cells(listed: str | None) -> list[CellFile]:
        return read_cells(spark, usable_paths(listed), config.delim, config.quotes)

    with report.phase("reading"):
        node_files, rel_files = cells(config.nodes), cells(config.rels)
        index_files = {s.name: cells(s.file) for s in config.indexes if s.file}
    earlier = Graph.read(spark, config.graph) if config.keep and Graph.exists(spark, config.graph) else None
    before = [t.count() for t in (earlier.nodes, earlier.relationships)] if earlier else [0, 0]
    with report.phase("planning"):
        graph, counts = load(spark, node_files, rel_files, config.indexes, index_files, earlier, config.separator, config.regex)
    graph.write(config.graph, config.keep, report.phase)
    written = Graph.read(spark, config.graph)
    nodes, rels = written.nodes.count() - before[0], written.relationships.count() - before[1]  # of Parquet's own counts
    rows = known_rows(rel_files)
    skipped = rows - rels if rows is not None else counts.first().skipped
    report.count("nodes", nodes)
    report.count("relationships", rels)
    if skipped:
        log.info("relationships skipped: %d", skipped)
    total = {"nodes": nodes, "relationships": rels, "skipped": skipped, "seconds": round(time.monotonic() - began, 1), "phases": {p: round(x, 1) for p, x in report.seconds.items()}}
    log.info("%s", total)
    return total


def main(args: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO)
    try:
        config = LoadConfig.from_args(sys.argv[1:] if args is None else args)
    except (ConfigError, ValueError) as e:
        print(f"{e}\n{USAGE}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    print(run(spark, config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
