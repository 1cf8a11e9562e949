"""Queries of the graph loader over the driver's tables: tables are rendered as cells and go through the loader's own operators."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.cli import run
from weftgraph.config import LoadConfig, NamedArgs, is_set, parse_properties
from weftgraph.functions import util
from weftgraph.functions.convert import split_array, split_labels
from weftgraph.operators import graph, index, rows, sorting
from weftgraph.operators.ids import assign_ids
from weftgraph.schema import HeaderField, parse_header
from weftgraph.session import read_table, shared_path
from weftgraph.sources import generate
from weftgraph.sources.cells import CellFile, cells_from_table, filesystem, number_lines, read_cells, usable_paths

Q = Callable[[SparkSession, str], DataFrame]
CUSTOMER = parse_header(["id:id", "name:string:customers", "acctbal:double", "seg:label"])
SUPPLIER = parse_header(["id:id", "name:string:suppliers", "acctbal:double"])
PART = parse_header(["id:id", "name:string:parts", "size:int", "price:double"])
ORDER = parse_header(["name:string:customers", "end", "type", "price:double", "status:string:orders"])


def _customers(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return cells_from_table(read_table(spark, d, "customer").where(where), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], "c_custkey")


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return cells_from_table(read_table(spark, d, "supplier"), ["s_suppkey", "s_name", "s_acctbal"], "s_suppkey", 2)


def _typed(cells: DataFrame, fields: list[HeaderField], offset: int = 0) -> DataFrame:
    return rows.typed_rows(rows.stop_at_blank(cells, len(fields)), fields, offset)


def _customer_index(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return index.entries(_typed(_customers(spark, d, where), CUSTOMER), CUSTOMER, "node_index")


def _part_index(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "part"), ["p_partkey", "p_name", "p_size", "p_retailprice"], "p_partkey")
    return index.entries(_typed(cells, PART), PART, "node_index")


def _order_cells(spark: SparkSession, d: str) -> DataFrame:
    named = read_table(spark, d, "orders").join(read_table(spark, d, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return cells_from_table(named, ["c_name", "o_orderkey", F.lit("PLACED"), "o_totalprice", "o_orderstatus"], "o_orderkey")


def _order_rows(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return graph.resolved_rows(_order_cells(spark, d), ORDER, _customer_index(spark, d, where))


RICH = "c_acctbal > 0"


def _last(spark: SparkSession, d: str, table: str, key: str) -> int | None:
    """The largest key of a table whose keys stand for line numbers."""
    return read_table(spark, d, table).agg(F.max(key)).first()[0]


def nodes(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(_customers(spark, d), CUSTOMER)
    made = graph.with_ids(typed, [CellFile("customer", CUSTOMER, typed)])
    return made.select("id", F.get("labels", F.lit(0)).alias("label"), "props.name", "props.acctbal")


def relationships(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["start", "end", "kind:label", "price:double"])
    cells = cells_from_table(read_table(spark, d, "orders"), ["o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice"], "o_orderkey")
    made = graph.relationships_of(graph.resolved_rows(cells, fields, None), total=_last(spark, d, "orders", "o_orderkey"), unique=True)
    return made.select("id", "start", "end", "type", "props.price")


def rels_literal_ids(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["start", "end", "type", "quantity:double", "number:int", "shipped"])
    cells = cells_from_table(read_table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", F.lit("HAS"), "l_quantity", "l_linenumber", "l_shipdate"], "l_orderkey")
    return graph.resolved_rows(cells, fields, None).where(graph.is_resolved()).select("start", "end", "type", "props.quantity", "props.number", "props.shipped")


def rels_by_index(spark: SparkSession, d: str) -> DataFrame:
    nations = cells_from_table(read_table(spark, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")
    regions = cells_from_table(read_table(spark, d, "region"), ["r_regionkey", "r_name"], "r_regionkey")
    nation, region = parse_header(["id:id", "name:string:nations"]), parse_header(["id:id", "name:string:regions"])
    both = index.entries(_typed(nations, nation), nation, "node_index").unionByName(index.entries(_typed(regions, region), region, "node_index"))
    named = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = cells_from_table(named, ["n_name", "r_name", F.lit("IN")], "n_nationkey")
    fields = parse_header(["name:string:nations", "name:string:regions", "type"])
    return graph.resolved_rows(cells, fields, both).where(graph.is_resolved()).select("start", "end", "type")


def rels_mixed_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _order_rows(spark, d).where(graph.is_resolved()).select("start", "end", "type", "props.price")


def skip_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return _order_rows(spark, d, RICH).where(graph.is_resolved()).select("start", "end")


def unresolved_rows(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoint_rows(_order_cells(spark, d), ORDER, _customer_index(spark, d, RICH), False).select(F.get("cells", F.lit(1)).cast("bigint").alias("end"))


def resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoint_rows(_order_cells(spark, d), ORDER, _customer_index(spark, d, RICH)).select(F.get("cells", F.lit(1)).cast("bigint").alias("end"))


def rels_by_typed_index(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the files of nodes and of relationships write in different ways: 7.50 and 7.5, 007 and +7, TRUE and true."""
    part, key = read_table(spark, d, "part"), F.col("p_partkey").cast("string")
    forms = {
        "double": (F.concat(key, F.lit(".50")), F.concat(F.lit("+"), key, F.lit(".5"))),
        "int": (F.concat(F.lit("00"), key), F.concat(F.lit("+"), key)),
        "boolean": (F.when(F.col("p_partkey") == 0, "TRUE").when(F.col("p_partkey") == 1, "no"), F.when(F.col("p_partkey") == 0, "true").otherwise("other")),
        "int_array": (F.concat(key, F.lit(",01")), F.concat(F.lit("0"), key, F.lit(",1"))),
    }
    out = []
    for kind, (stored, asked) in forms.items():
        nodes, rels = parse_header(["id:id", f"key:{kind}:keys"]), parse_header([f"key:{kind}:keys", "end:long", "type"])
        keys = index.entries(_typed(cells_from_table(part, ["p_partkey", stored], "p_partkey"), nodes), nodes, "node_index")
        cells = cells_from_table(part, [asked, F.concat(F.lit("0"), key), F.lit(kind)], "p_partkey")
        out.append(graph.resolved_rows(cells, rels, keys).where(graph.is_resolved()).select("start", "end", "type"))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def import_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.import_counts(_order_rows(spark, d, RICH))


def rel_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationships_of(_order_rows(spark, d, RICH), total=_last(spark, d, "orders", "o_orderkey"), unique=True).select("id", "start", "end")


def index_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.hit_counts(_part_index(spark, d))


def index_distinct(spark: SparkSession, d: str) -> DataFrame:
    twice = _part_index(spark, d).unionByName(_part_index(spark, d))
    return index.distinct_entries(twice).select("entity_id", "property", "value")


def index_ordered(spark: SparkSession, d: str) -> DataFrame:
    return assign_ids(_part_index(spark, d), ["value", "entity_id"], 1, "place").select("place", "value", "entity_id")


def index_get(spark: SparkSession, d: str) -> DataFrame:
    return index.index_get(_customer_index(spark, d), "customers", "name", "Customer#000000007")


def auto_index(spark: SparkSession, d: str) -> DataFrame:
    suppliers = index.entries(_typed(_suppliers(spark, d), SUPPLIER), SUPPLIER, "node_index")
    return _customer_index(spark, d).unionByName(suppliers).select(*index.ENTRY)


def auto_index_rels(spark: SparkSession, d: str) -> DataFrame:
    made = graph.relationships_of(_order_rows(spark, d), total=_last(spark, d, "orders", "o_orderkey"), unique=True)
    return index.entries(made, ORDER, "relationship_index", graph.REL_OFFSET).select(*index.ENTRY)


def _file_entries(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["id", "segment", "nation:int"])
    cells = cells_from_table(read_table(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_nationkey"], "c_custkey")
    typed = rows.typed_rows(rows.stop_at_blank(cells, 3), fields, 1, keep=("cells",))
    placed = typed.select(graph.literal_id(F.get("cells", F.lit(0)), "entity").alias("id"), "props")
    return index.file_entries(placed, fields, index.IndexSpec("node_index", "customers"))


def index_file_import(spark: SparkSession, d: str) -> DataFrame:
    return _file_entries(spark, d).select(*index.ENTRY)


def index_union(spark: SparkSession, d: str) -> DataFrame:
    return _customer_index(spark, d).unionByName(_file_entries(spark, d)).select(*index.ENTRY)


def _two_files(spark: SparkSession, d: str) -> tuple[DataFrame, list[CellFile]]:
    first = cells_from_table(read_table(spark, d, "customer"), ["c_name", "c_acctbal", "c_mktsegment"], "c_custkey", 1)
    second = cells_from_table(read_table(spark, d, "supplier"), ["s_name", "s_nationkey"], "s_suppkey", 2)
    files = [CellFile("customer", parse_header(["name", "acctbal:double", "seg:label"]), first), CellFile("supplier", parse_header(["name", "nation:int"]), second)]
    return graph.node_rows(files), files


def implicit_ids(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_ids(*_two_files(spark, d)).select("id", "props.name")


def mixed_ids(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["name", "nation:int"])
    own = parse_header(["id:id", "name", "acctbal:double", "seg:label"])
    cells = cells_from_table(read_table(spark, d, "supplier"), ["s_name", "s_nationkey"], "s_suppkey", 1)
    files = [CellFile("supplier", fields, cells), CellFile("customer", own, _customers(spark, d).withColumn("file_no", F.lit(2)))]
    return graph.with_ids(graph.node_rows(files), files).select("id", "props.name")


def explicit_ids(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "part"), ["p_partkey", "p_name", "p_size", "p_retailprice"], "p_partkey")
    return _typed(cells, PART).select("id", "props.name", "props.size", "props.price")


def multi_file_union(spark: SparkSession, d: str) -> DataFrame:
    return _two_files(spark, d)[0].select("file_no", "line_no", "props.name", "props.acctbal", "props.nation")


def keep_graph(spark: SparkSession, d: str) -> DataFrame:
    target = shared_path(spark, "kept")
    fields = parse_header(["name:string:names"])
    specs = [index.IndexSpec("node_index", "names")]
    for table, name, key, keep in (("customer", "c_name", "c_custkey", False), ("supplier", "s_name", "s_suppkey", True)):
        file = CellFile(table, fields, cells_from_table(read_table(spark, d, table), [name], key))
        made, _ = graph.load(spark, [file], [], specs, earlier=graph.Graph.read(spark, target) if keep else None)
        made.write(target, keep)
    return graph.Graph.read(spark, target).nodes.select("id", "props.name")


def cast_scalars(spark: SparkSession, d: str) -> DataFrame:
    names = ["quantity:double", "price:float", "line:int", "key:long", "short:short", "byte:byte", "flag:char", "open:boolean", "text"]
    line = read_table(spark, d, "lineitem")
    cells = cells_from_table(line, ["l_quantity", "l_discount", "l_linenumber", "l_orderkey", F.col("l_suppkey") % 30000, F.col("l_linenumber"), F.concat("l_returnflag", F.lit("xyz")), F.when(F.col("l_linestatus") == "O", "TRUE").otherwise("yes"), "l_linestatus"], "l_orderkey")
    return _typed(cells, parse_header(names)).select("props.*")


def cast_arrays(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    text = F.concat_ws(",", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"))
    cells = cells_from_table(part, ["p_partkey", text, F.regexp_replace("p_type", " ", ","), F.concat_ws(",", F.col("p_retailprice").cast("string"), F.lit("2.5"))], "p_partkey")
    p = _typed(cells, parse_header(["id:id", "numbers:int_array", "words:string_array", "prices:double_array"]))
    return p.select("id", F.element_at("props.numbers", 1).alias("n1"), F.element_at("props.numbers", 2).alias("n2"), F.size("props.words").alias("words"), F.array_join("props.words", "/").alias("text"), F.element_at("props.prices", 2).alias("p2"))


def label_split(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    labels = split_labels(F.concat(F.lit("  "), "p_type", F.lit(" , "), "p_brand", F.lit(" ,, ")))
    return part.select("p_partkey", F.size(labels).alias("n"), F.array_join(labels, "|").alias("labels"))


def node_labels(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "part"), ["p_partkey", F.concat_ws(",", "p_brand", "p_type"), "p_name"], "p_partkey")
    fields = parse_header(["id:id", "x:label", "name"])
    return _typed(cells, fields).select("id", F.size("labels").alias("n_labels"), F.get("labels", F.lit(0)).alias("first_label"))


def rel_type(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["start", "end", "x", "kind:label"])
    cells = cells_from_table(read_table(spark, d, "orders"), ["o_custkey", "o_orderkey", F.lit("q"), "o_orderpriority"], "o_orderkey")
    return graph.resolved_rows(cells, fields, None).select("end", "type")


def _sparse(spark: SparkSession, d: str) -> tuple[DataFrame, list[HeaderField]]:
    table = read_table(spark, d, "customer")
    cells = cells_from_table(table, ["c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), F.lit("")], "c_custkey")
    fields = parse_header(["id:id", "segment", "balance:double", "nothing"])
    return _typed(cells, fields), fields


def project_properties(spark: SparkSession, d: str) -> DataFrame:
    typed, _ = _sparse(spark, d)
    return typed.select("id", "props.*")


def property_count(spark: SparkSession, d: str) -> DataFrame:
    typed, _ = _sparse(spark, d)
    return typed.select("id", rows.property_count(typed).cast("int").alias("n"))


def properties_as_map(spark: SparkSession, d: str) -> DataFrame:
    typed, _ = _sparse(spark, d)
    return typed.select("id", F.explode(rows.as_map(typed)).alias("name", "value"))


def empty_is_null(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "documents"), [F.coalesce("lang", F.lit("")), "source"], "doc_id")
    return cells.select(F.col("line_no").alias("doc_id"), rows.cell_at(0).alias("lang"), rows.cell_at(1).alias("source"))


def stop_at_blank_row(spark: SparkSession, d: str) -> DataFrame:
    shown: list[Column] = [F.when(F.col("event_id") != 4321, F.col(c)) for c in ("event_id", "event_type")]
    cells = cells_from_table(read_table(spark, d, "events"), shown, "event_id")
    return rows.stop_at_blank(cells, 2).select(F.col("line_no").alias("event_id"), F.get("cells", F.lit(1)).alias("event_type"))


def scan_ragged_rows(spark: SparkSession, d: str) -> DataFrame:
    table = read_table(spark, d, "customer").withColumn("k", F.pmod("c_custkey", F.lit(3)))
    full = F.array(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    cut = F.when(F.col("k") == 0, F.slice(full, 1, 2)).when(F.col("k") == 1, F.concat(full, F.array(F.lit("surplus")))).otherwise(full)
    cells = table.select(F.lit(1).alias("file_no"), F.col("c_custkey").alias("line_no"), cut.alias("cells"))
    return _typed(cells, parse_header(["id:id", "name", "segment"])).select("id", "props.*")


def sort_relationships(spark: SparkSession, d: str) -> DataFrame:
    value = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.lit("x"))
    lines = read_table(spark, d, "lineitem").select(value.alias("value"), F.monotonically_increasing_id().alias("line_no"))
    return sorting.sorted_places(lines).select("place", "lo", "hi")


def sort_file(spark: SparkSession, d: str) -> DataFrame:
    """A relationship file sorted into text files and read again: line_no counts through the files in their order."""
    value = F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority")
    source = _written(spark, read_table(spark, d, "orders").select(value), "start\tend\ttype", "", 1)[0]
    target = shared_path(spark, "sorted")
    sorting.sort_file(spark, source, target)
    paths = _part_files(target)
    lines = number_lines(spark, paths, list(range(1, len(paths) + 1)))
    before, at = [], 0
    for n in sorted(lines.counts):
        before.append((n, at))
        at += lines.counts[n]
    cells = F.split("value", "\t")
    placed = lines.rows.join(F.broadcast(spark.createDataFrame(before, "file_no int, before bigint")), "file_no")
    return placed.select((F.col("before") + F.col("line_no")).alias("place"), F.get(cells, F.lit(0)).alias("start"), F.get(cells, F.lit(1)).alias("end"), F.get(cells, F.lit(2)).alias("type"))


def limit_rows(spark: SparkSession, d: str) -> DataFrame:
    return sorting.first_rows(read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, at = filesystem(path)
            with system.open_input_stream(at) as body, system.open_output_stream(f"{at}.zip") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                with archive.open("rows.csv", "w", force_zip64=True) as entry:
                    while chunk := body.read(1 << 20):
                        entry.write(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path}.zip"])], names=["path"])


def _part_files(folder: str) -> list[str]:
    system, at = filesystem(folder)
    prefix = folder.removesuffix(at)
    return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.startswith("part-") and f.size)


def _written(spark: SparkSession, lines: DataFrame, header: str, suffix: str, n: int | None = None) -> list[str]:
    """Text files of ``lines`` in the shared folder, each with the header, so that a scan has something to read. Written and packed by tasks."""
    folder = shared_path(spark, "scan")
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = lines.toDF("value").select(F.pmod(F.xxhash64("value"), F.lit(n)).cast("int").alias("part"), F.lit(1).alias("ord"), "value")
    heads = spark.range(n).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("ord"), F.lit(header).alias("value"))
    each = body.unionByName(heads).repartitionById(n, F.col("part")).sortWithinPartitions("ord")
    each.select("value").write.option("lineSep", "\n").option("compression", "gzip" if suffix == ".gz" else "none").text(folder)
    paths = _part_files(folder)
    if suffix == ".zip":
        paths = sorted(r.path for r in spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInArrow(_zipped, "path string").collect())
    return paths


def _scanned(spark: SparkSession, paths: list[str], quotes: bool) -> DataFrame:
    return rows.union_rows([rows.typed_rows(f.rows, f.fields) for f in read_cells(spark, paths, "\t", quotes)])


def _scan_customers(spark: SparkSession, d: str, suffix: str, quotes: bool) -> DataFrame:
    text = read_table(spark, d, "customer").select(F.concat_ws("\t", F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), "c_mktsegment"))
    paths = _written(spark, text, "id:id\tname:string:customers\tacctbal:double\tseg:label", suffix)
    return _scanned(spark, paths, quotes).select("id", "props.name", "props.acctbal")


def scan_plain(spark: SparkSession, d: str) -> DataFrame:
    return _scan_customers(spark, d, "", False)


def scan_raw_rows(spark: SparkSession, d: str) -> DataFrame:
    return _scan_customers(spark, d, "", True)


def scan_gzip(spark: SparkSession, d: str) -> DataFrame:
    return _scan_customers(spark, d, ".gz", False)


def scan_zip(spark: SparkSession, d: str) -> DataFrame:
    return _scan_customers(spark, d, ".zip", True)


def scan_quoted(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    text = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""'))
    paths = _written(spark, docs.select(F.concat(F.col("doc_id").cast("string"), F.lit('\t"'), F.coalesce(text, F.lit("")), F.lit('"'))), "id:id\ttext", "")
    return _scanned(spark, paths, True).select(F.col("id").alias("doc_id"), "props.text")


def scan_legacy(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "customer"), ["c_custkey", F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lit("  ")).otherwise(F.col("c_name")), "c_mktsegment"], "c_custkey")
    typed = rows.typed_rows(cells, parse_header(["id:id", "name", "type"]), legacy=True)
    return typed.select("id", "props.name", F.get("labels", F.lit(0)).alias("label"))


def parse_header_rows(spark: SparkSession, d: str) -> DataFrame:
    fields = parse_header(["name:string:users", "age", ":label", "n:INT", "xs:Float_Array:idx", "id:id"])
    return spark.createDataFrame([(f.position, f.name, f.type, f.index) for f in fields], "position int, name string, type string, index_name string")


TYPES = ["A", "B", "C"]


def gen_random_graph(spark: SparkSession, d: str) -> DataFrame:
    return generate.random_graph(spark, 1000, 10, TYPES)[1]


def gen_sorted_graph(spark: SparkSession, d: str) -> DataFrame:
    return generate.sorted_graph(spark, 1000, 10, TYPES)[1]


def _facts(nodes: DataFrame, rels: DataFrame, up: bool) -> DataFrame:
    """What holds of every generated graph, as counts: one row. ``up``: each relationship joins its node with one of the same or a higher number."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.pmod("Counter", F.lit(3)) + 1).cast("int"))
    of_rels = rels.agg(
        F.count_if(F.col("Start").between(0, 999) & F.col("Ende").between(0, 999)).alias("inside"), F.count("*").alias("rels"), F.count_if(F.col("Type") != kind).alias("bad_types"),
        F.count_distinct("Counter").alias("most"), F.count_if(F.col("Counter") == 0).alias("last_ones"), F.count_if(F.length("Property") == 8).alias("named"), F.count_distinct(F.least("Start", "Ende")).alias("lows"),
    )
    of_nodes = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("Node").alias("numbers"), F.sum(F.col("Rels") + 1).alias("planned"), F.min("Rels").alias("least"), F.count_distinct("Label").alias("labels"))
    both = of_rels.join(of_nodes)  # two rows of totals
    checks = {
        "all_inside": F.col("inside") == F.col("rels"), "as_planned": F.col("rels") == F.col("planned"), "bad_types": F.col("bad_types"), "most": F.col("most"), "last_ones": F.col("last_ones"),
        "all_named": F.col("named") == F.col("rels"), "nodes": F.col("nodes"), "numbers": F.col("numbers"), "least": F.col("least"), "labels": F.col("labels"), "every_low": (F.col("lows") == F.col("nodes")) if up else F.lit(True),
    }
    return both.select(*[c.alias(n) for n, c in checks.items()])


def gen_random_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(*generate.random_graph(spark, 1000, 10, TYPES), False)


def gen_sorted_facts(spark: SparkSession, d: str) -> DataFrame:
    return _facts(*generate.sorted_graph(spark, 1000, 10, TYPES), True)


def gen_files(spark: SparkSession, d: str) -> DataFrame:
    """The generator's text files read by the loader: rows and sums of a ring graph's columns."""
    nodes, rels = generate.ring_graph(spark, 1000, [1, 7, 999])
    folder = shared_path(spark, "generated")
    generate.write_files(nodes.selectExpr("id", "blocked", "'x' as p", "'L' as l", "age"), rels.selectExpr("start", "end", "type", "weight", "id"), folder)
    out = []
    for what, column in (("nodes", "Counter"), ("rels", "Counter")):
        made = [rows.typed_rows(f.rows, f.fields) for f in read_cells(spark, _part_files(f"{folder}/{what}"), "\t", False)]
        out.append(rows.union_rows(made).agg(F.count("*").alias("n"), F.sum(f"props.{column}").cast("bigint").alias("total")).select(F.lit(what).alias("what"), "n", "total"))
    return out[0].unionByName(out[1])


def gen_ring_graph(spark: SparkSession, d: str) -> DataFrame:
    return generate.ring_graph(spark, 1000, [1, 7, 999])[1]


def convert_errors(spark: SparkSession, d: str) -> DataFrame:
    cells = cells_from_table(read_table(spark, d, "nodes"), ["row_id", "age", F.lit("1.5")], "row_id")
    return rows.conversion_errors(cells, parse_header(["id:id", "age:int", "x:double"])).select("line_no", "position", "name", "type", "value")


def fulltext_tokens(spark: SparkSession, d: str) -> DataFrame:
    return index.fulltext_tokens(read_table(spark, d, "documents"), "doc_id", "text")


def util_join(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", util.join(split_array(F.col("p_type"), " "), ", ").alias("joined"))


def util_size(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    n = F.pmod("p_partkey", F.lit(4)).cast("int")
    padded = F.concat(F.slice(F.array(F.lit(5), F.lit(-1), F.lit(6)), F.lit(1), n), F.array(F.lit(-1), F.lit(-1)))
    return part.select("p_partkey", util.logical_size(padded).alias("n"))


def raw_cell(spark: SparkSession, d: str) -> DataFrame:
    return _customers(spark, d).select(F.col("line_no").alias("id"), F.get("cells", F.lit(1)).alias("second"), F.get("cells", F.lit(9)).alias("tenth"))


def read_header(spark: SparkSession, d: str) -> DataFrame:
    """The headers of files, with and without quotes: the fields that the reader finds."""
    out = []
    body = read_table(spark, d, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name"))
    for quotes, header in ((True, '"id:id"\t"the\tname:string:x"\t\t:label'), (False, "id:id\tname\t\tn:int")):
        for f in read_cells(spark, _written(spark, body, header, "", 1), "\t", quotes)[0].fields:
            out.append((quotes, f.position, f.name, f.type, f.index))
    return spark.createDataFrame(out, "quotes boolean, position int, name string, type string, index_name string")


def file_list(spark: SparkSession, d: str) -> DataFrame:
    """A list with files that aren't there: the others are loaded, numbered in the order of the list."""
    lists = []
    for table, key, name in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
        lists.append(_written(spark, read_table(spark, d, table).select(F.concat_ws("\t", F.col(key).cast("string"), name)), "id:id\tname", "", 1)[0])
    paths = usable_paths(f" {lists[0]},{lists[0]}.none ,,{lists[1]}, /")
    return _scanned(spark, paths, True).select("file_no", "id", "props.name")


def load_graph(spark: SparkSession, d: str) -> DataFrame:
    """A whole load of files, by its configuration, into a graph directory: the counts of its report and of what was written."""
    customers = read_table(spark, d, "customer").select(F.concat_ws("\t", "c_name", F.col("c_acctbal").cast("string"), "c_mktsegment"))
    made = _order_cells(spark, d).select(F.concat_ws("\t", F.get("cells", F.lit(0)), F.concat(F.lit("Customer#"), F.lpad(F.get("cells", F.lit(1)), 9, "0")), F.lit("KNOWS"), F.get("cells", F.lit(3))))
    files = {"nodes": _written(spark, customers, "name:string:users\tbalance:double\tseg:label", ""), "rels": _written(spark, made, "name:string:users\tname:string:users\ttype\tprice:double", "")}
    target = shared_path(spark, "loaded")
    settings = {"batch_import.graph_db": target, "batch_import.nodes_files": ",".join(files["nodes"]), "batch_import.rels_files": ",".join(files["rels"]), "batch_import.node_index.users": "fulltext"}
    report = run(spark, LoadConfig.from_settings(settings))
    written = graph.Graph.read(spark, target)
    facts = {f"report {k}": report[k] for k in ("nodes", "relationships", "skipped")} | {"phases": len(report["phases"])}
    facts |= {"nodes": written.nodes.count(), "rels": written.relationships.count(), "entries": written.index.count(), "words": written.tokens.count()}
    facts |= {"customer words": index.search(written.tokens, "users", "name", "CUSTOMER").count(), "dangling": graph.dangling(written.relationships, written.nodes).count()}
    return spark.createDataFrame(list(facts.items()), "what string, n bigint")


def option_words(spark: SparkSession, d: str) -> DataFrame:
    words = ["true", "TRUE", "tRue", "yes", "1", "", " true", "false", "False", "no"]
    return spark.createDataFrame([(w, is_set({"k": w}, "k", "true"), is_set({"k": w}, "k", "false")) for w in words], "word string, is_true boolean, is_false boolean")


def properties_entries(spark: SparkSession, d: str) -> DataFrame:
    lines = ["# no entry", "! nor this", "", "batch_import.csv.delim=|", "  batch_array_separator = ; ", "path:with=both", "alone", "tab=\\t", "twice=1", "twice=2"]
    return spark.createDataFrame(list(parse_properties(lines).items()), "entry string, value string")


def index_specs(spark: SparkSession, d: str) -> DataFrame:
    """Configuration entries as indexes: keys that name none, and kinds and types that there aren't."""
    entries = [("batch_import.node_index.users", "exact"), ("batch_import.relationship_index.a.b", "fulltext:x.csv"), ("batch_import.node_index.", "exact"), ("batch_import.rel_index.x", "exact"), ("x.batch_import.node_index.y", "exact"), ("batch_import.node_index.z", "spatial")]
    out = []
    for key, value in entries:
        try:
            spec = index.IndexSpec.from_entry(key, value)
            out.append((key, spec is not None, *((spec.kind, spec.name, spec.mode, spec.file, spec.key == key and spec.value == value) if spec else [None] * 5)))
        except ValueError:
            out.append((key, None, None, None, None, None, None))
    return spark.createDataFrame(out, "entry string, is_index boolean, kind string, name string, mode string, file string, same boolean")


def named_args(spark: SparkSession, d: str) -> DataFrame:
    args = NamedArgs(["a.csv", "7"], "File", "count")
    out = [("FILE", args.text("FILE")), ("Count", str(args.number("Count") + 1)), ("invalid", str(args.invalid)), ("more names", str(NamedArgs(["x"], "a", "b").invalid))]
    return spark.createDataFrame(out, "name string, value string")


_NAMED = (
    nodes, relationships, rels_literal_ids, rels_by_index, rels_by_typed_index, rels_mixed_endpoints, skip_unresolved, unresolved_rows, resolved_rows, import_counts, rel_ids, index_hit_counts, index_distinct,
    index_ordered, index_get, auto_index, auto_index_rels, index_file_import, index_union, implicit_ids, explicit_ids, mixed_ids, multi_file_union, keep_graph, cast_scalars, cast_arrays, label_split, node_labels,
    rel_type, project_properties, property_count, properties_as_map, empty_is_null, stop_at_blank_row, scan_ragged_rows, sort_relationships, sort_file, limit_rows, scan_plain, scan_raw_rows, scan_gzip, scan_zip,
    scan_quoted, scan_legacy, gen_random_graph, gen_sorted_graph, gen_random_facts, gen_sorted_facts, gen_files, gen_ring_graph, convert_errors, fulltext_tokens, util_join, util_size, raw_cell, read_header,
    file_list, load_graph, option_words, properties_entries, index_specs, named_args,
)
QUERIES: dict[str, Q] = {f.__name__: f for f in _NAMED} | {"parse_header": parse_header_rows}

_RICH = "(select c_name from customer where c_acctbal > 0)"
_ORDERS = "from orders join customer on o_custkey = c_custkey"
_PART_INDEX = "(select p_partkey as entity_id, 'name' as property, p_name as value from part)"
_CUST_ENTRIES = "select 'customers' as index_name, 'node_index' as kind, c_custkey as entity_id, 'name' as property, 'STRING' as value_type, c_name as value from customer"
_FILE_ENTRIES = """select 'customers' as index_name, 'node_index' as kind, c_custkey as entity_id, 'segment' as property, 'STRING' as value_type, c_mktsegment as value from customer
union all select 'customers', 'node_index', c_custkey, 'nation', 'INT', cast(c_nationkey as varchar) from customer"""
_CUSTOMERS = "select c_custkey as id, c_name as name, c_acctbal as acctbal from customer"
SQL: dict[str, str] = {
    "nodes": "select c_custkey as id, c_mktsegment as label, c_name as name, c_acctbal as acctbal from customer",
    "relationships": 'select row_number() over (order by o_orderkey) - 1 as id, o_custkey as start, o_orderkey as "end", o_orderpriority as type, o_totalprice as price from orders',
    "rels_literal_ids": "select l_orderkey as start, l_partkey as \"end\", 'HAS' as type, l_quantity as quantity, l_linenumber as number, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as shipped from lineitem",
    "rels_by_index": "select n_nationkey as start, r_regionkey as \"end\", 'IN' as type from nation join region on n_regionkey = r_regionkey",
    "rels_by_typed_index": """select p_partkey as start, p_partkey as "end", t as type from part, (values ('double'), ('int'), ('int_array')) k(t)
union all select case when p_partkey = 0 then 0 else 1 end, p_partkey, 'boolean' from part""",
    "rels_mixed_endpoints": f"select c_custkey as start, o_orderkey as \"end\", 'PLACED' as type, o_totalprice as price {_ORDERS}",
    "skip_unresolved": f'select c_custkey as start, o_orderkey as "end" {_ORDERS} where c_acctbal > 0',
    "unresolved_rows": f'select o_orderkey as "end" {_ORDERS} where c_name not in {_RICH}',
    "resolved_rows": f'select o_orderkey as "end" {_ORDERS} where c_name in {_RICH}',
    "import_counts": f"select count(*) filter (c_acctbal > 0) as imported, count(*) filter (not c_acctbal > 0) as skipped {_ORDERS}",
    "rel_ids": f'select row_number() over (order by o_orderkey) - 1 as id, c_custkey as start, o_orderkey as "end" {_ORDERS} where c_acctbal > 0',
    "index_hit_counts": f"select 'parts' as index_name, property, value, count(*) as hits from {_PART_INDEX} group by all",
    "index_distinct": f"select distinct * from {_PART_INDEX}",
    "index_ordered": f"select row_number() over (order by value, entity_id) as place, value, entity_id from {_PART_INDEX}",
    "index_get": "select c_custkey as entity_id from customer where c_name = 'Customer#000000007'",
    "auto_index": f"{_CUST_ENTRIES} union all select 'suppliers', 'node_index', s_suppkey, 'name', 'STRING', s_name from supplier",
    "auto_index_rels": "select 'orders' as index_name, 'relationship_index' as kind, row_number() over (order by o_orderkey) - 1 as entity_id, 'status' as property, 'STRING' as value_type, o_orderstatus as value from orders",
    "index_file_import": _FILE_ENTRIES,
    "index_union": f"{_CUST_ENTRIES} union all {_FILE_ENTRIES}",
    "implicit_ids": "select row_number() over (order by f, k) - 1 as id, name from (select 1 as f, c_custkey as k, c_name as name from customer union all select 2, s_suppkey, s_name from supplier)",
    "explicit_ids": "select p_partkey as id, p_name as name, p_size as size, p_retailprice as price from part",
    "mixed_ids": "select c_custkey as id, c_name as name from customer union all select (select max(c_custkey) from customer) + row_number() over (order by s_suppkey), s_name from supplier",
    "multi_file_union": "select 1 as file_no, c_custkey as line_no, c_name as name, c_acctbal as acctbal, null::int as nation from customer union all select 2, s_suppkey, s_name, null, s_nationkey from supplier",
    "keep_graph": "select row_number() over (order by f, k) - 1 as id, name from (select 1 as f, c_custkey as k, c_name as name from customer union all select 2, s_suppkey, s_name from supplier)",
    "cast_scalars": """select l_quantity as quantity, l_discount::float as price, l_linenumber as line, l_orderkey as key, (l_suppkey % 30000)::smallint as short, l_linenumber::tinyint as byte,
left(l_returnflag, 1) as flag, l_linestatus = 'O' as open, l_linestatus as text from lineitem""",
    "cast_arrays": "select p_partkey as id, p_size as n1, p_partkey::int as n2, len(string_split(p_type, ' ')) as words, replace(p_type, ' ', '/') as text, 2.5::double as p2 from part",
    "label_split": "select p_partkey, 2 as n, trim(p_type) || '|' || trim(p_brand) as labels from part",
    "node_labels": "select p_partkey as id, len(string_split(p_brand || ',' || p_type, ',')) as n_labels, p_brand as first_label from part",
    "rel_type": 'select o_orderkey as "end", o_orderpriority as type from orders',
    "project_properties": "select c_custkey as id, nullif(c_mktsegment, 'BUILDING') as segment, case when c_acctbal > 0 then c_acctbal end as balance, null::varchar as nothing from customer",
    "property_count": "select c_custkey as id, case when c_mktsegment <> 'BUILDING' then 1 else 0 end + case when c_acctbal > 0 then 1 else 0 end as n from customer",
    "properties_as_map": "select c_custkey as id, 'segment' as name, c_mktsegment as value from customer where c_mktsegment <> 'BUILDING' union all select c_custkey, 'balance', c_acctbal::varchar from customer where c_acctbal > 0",
    "empty_is_null": "select doc_id, nullif(lang, '') as lang, nullif(source, '') as source from documents",
    "stop_at_blank_row": "select event_id, event_type from events where event_id < 4321",
    "scan_ragged_rows": "select c_custkey as id, c_name as name, case when c_custkey % 3 <> 0 then c_mktsegment end as segment from customer",
    "sort_relationships": "select row_number() over (order by lo, hi) as place, lo, hi from (select least(l_orderkey, l_partkey) as lo, greatest(l_orderkey, l_partkey) as hi from lineitem)",
    "sort_file": """select row_number() over (order by least(o_orderkey, o_custkey), greatest(o_orderkey, o_custkey)) as place, o_orderkey::varchar as start, o_custkey::varchar as "end", o_orderpriority as type from orders
union all select 0, 'start', 'end', 'type'""",
    "limit_rows": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1000",
    "scan_plain": _CUSTOMERS,
    "scan_raw_rows": _CUSTOMERS,
    "scan_gzip": _CUSTOMERS,
    "scan_zip": _CUSTOMERS,
    "scan_quoted": "select doc_id, nullif(text, '') as text from documents",
    "scan_legacy": "select c_custkey as id, case when c_custkey % 2 <> 0 then c_name end as name, c_mktsegment as label from customer",
    "gen_random_facts": "select true as all_inside, true as as_planned, 0 as bad_types, 11 as most, 1000 as last_ones, true as all_named, 1000 as nodes, 1000 as numbers, 1 as least, 3 as labels, true as every_low",
    "gen_sorted_facts": "select true as all_inside, true as as_planned, 0 as bad_types, 11 as most, 1000 as last_ones, true as all_named, 1000 as nodes, 1000 as numbers, 1 as least, 3 as labels, true as every_low",
    "gen_files": "select 'nodes' as what, 1000 as n, 42000 as total union all select 'rels', 3000, (select sum(range) from range(3000))",
    "gen_ring_graph": "select i * 3 + k as id, i as start, (i + o) % 1000 as \"end\", 'ONE' as type, 10::float as weight from range(1000) t(i), (values (0, 1), (1, 7), (2, 999)) v(k, o)",
    "convert_errors": "select row_id as line_no, 1 as position, 'age' as name, 'INT' as type, age as value from nodes where age <> '' and not coalesce(regexp_full_match(age, '[+-]?[0-9]+') and try_cast(age as int) is not null, false)",
    "fulltext_tokens": r"select distinct doc_id, token from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as token from documents) where token <> ''",
    "util_join": "select p_partkey, array_to_string(string_split(p_type, ' '), ', ') as joined from part",
    "util_size": "select p_partkey, case p_partkey % 4 when 0 then 2 when 1 then 1 when 2 then 1 else 3 end as n from part",
    "parse_header": """select * from (values (0, 'name', 'STRING', 'users'), (1, 'age', 'STRING', null), (2, '', 'LABEL', null), (3, 'n', 'INT', null), (4, 'xs', 'FLOAT_ARRAY', 'idx'), (5, 'id', 'ID', null)) t(position, name, type, index_name)""",
    "raw_cell": "select c_custkey as id, c_name as second, null::varchar as tenth from customer",
    "read_header": """select * from (values (true, 0, 'id', 'ID', null), (true, 1, 'the\tname', 'STRING', 'x'), (true, 2, '', 'STRING', null), (true, 3, '', 'LABEL', null),
(false, 0, 'id', 'ID', null), (false, 1, 'name', 'STRING', null), (false, 2, '', 'STRING', null), (false, 3, 'n', 'INT', null)) t(quotes, position, name, type, index_name)""",
    "file_list": "select 1 as file_no, n_nationkey as id, n_name as name from nation union all select 2, r_regionkey, r_name from region",
    "load_graph": """with r as (select exists (from customer c where c.c_name = 'Customer#' || lpad(o_orderkey::varchar, 9, '0')) as found from orders),
k as (select count(*) as n from customer), g as (select count(*) filter (found) as n, count(*) filter (not found) as skipped from r)
select 'report nodes' as what, n from k union all select 'report relationships', n from g union all select 'report skipped', skipped from g union all select 'phases', 5
union all select 'nodes', n from k union all select 'rels', n from g union all select 'entries', n from k union all select 'words', 2 * n from k union all select 'customer words', n from k union all select 'dangling', 0""",
    "option_words": """select * from (values ('true', true, false), ('TRUE', true, false), ('tRue', true, false), ('yes', false, false), ('1', false, false), ('', false, false), (' true', false, false),
('false', false, true), ('False', false, true), ('no', false, false)) t(word, is_true, is_false)""",
    "properties_entries": """select * from (values ('batch_import.csv.delim', '|'), ('batch_array_separator', '; '), ('path', 'with=both'), ('alone', ''), ('tab', '\t'), ('twice', '2')) t(entry, value)""",
    "index_specs": """select * from (values ('batch_import.node_index.users', true, 'node_index', 'users', 'exact', null, true), ('batch_import.relationship_index.a.b', true, 'relationship_index', 'a.b', 'fulltext', 'x.csv', true),
('batch_import.node_index.', false, null, null, null, null, null), ('batch_import.rel_index.x', false, null, null, null, null, null), ('x.batch_import.node_index.y', false, null, null, null, null, null),
('batch_import.node_index.z', null, null, null, null, null, null)) t(entry, is_index, kind, name, mode, file, same)""",
    "named_args": "select * from (values ('FILE', 'a.csv'), ('Count', '8'), ('invalid', 'False'), ('more names', 'True')) t(name, value)",
}
