import glob
import os
import time

import pytest

from weftgraph.cli import run
from weftgraph.config import LoadConfig
from weftgraph.operators.graph import Graph, dangling, load
from weftgraph.operators.index import IndexSpec, distinct_entries, index_get, search
from weftgraph.operators.ids import assign_ids, next_id, number_by_line
from weftgraph.operators.sorting import sort_file
from weftgraph.report import Phases
from weftgraph.sources import generate
from weftgraph.sources.cells import CellFile, read_cells
from weftgraph.schema import header_of
from weftgraph.streaming.append import append_nodes, append_stream, stream_rows

CELLS = "file_no int, line_no bigint, cells array<string>"
USERS = [IndexSpec("node_index", "users")]


def file(spark, text, number=1):
    head, *lines = text.split("\n")
    rows = [(number, i, x.split("\t")) for i, x in enumerate(lines, 1)]
    return CellFile("t", header_of(head), spark.createDataFrame(rows, CELLS))


def build(spark, nodes, rels, specs=USERS, **kw):
    node_files = [file(spark, t, i) for i, t in enumerate(nodes, 1)]
    rel_files = [file(spark, t, i) for i, t in enumerate(rels, 1)]
    return load(spark, node_files, rel_files, specs, **kw)


def node_rows(g):
    return [(r.id, r.labels, {k: v for k, v in r.props.asDict().items() if v is not None}) for r in g.nodes.orderBy("id").collect()]


def rel_rows(g):
    return [(r.id, r.start, r.end, r.type) for r in g.relationships.orderBy("id").collect()]


NO_RELS = ["start\tend\ttype\n0\t0\tT"]


def test_nodes_labels_and_ids(spark):
    g, _ = build(spark, ["title\t:label\nOak\ttree, tall ,\nElm\t\n", "height:int\n31"], NO_RELS)
    assert node_rows(g) == [(0, ["tree", "tall"], {"title": "Oak"}), (1, [], {"title": "Elm"}), (2, [], {"height": 31})]


def test_ids_are_given_once(spark):
    g, _ = build(spark, ["no:id\ttitle\n0\tOak\n1\tElm", "title\nAsh\nFir"], NO_RELS)
    assert node_rows(g) == [(0, [], {"title": "Oak"}), (1, [], {"title": "Elm"}), (2, [], {"title": "Ash"}), (3, [], {"title": "Fir"})]
    g, _ = build(spark, ["title\nAsh", "no:id\ttitle\n70\tOak", "title\nFir"], NO_RELS)
    assert [(r[0], r[2]["title"]) for r in node_rows(g)] == [(70, "Oak"), (71, "Ash"), (72, "Fir")]
    with pytest.raises(ValueError, match="several nodes with id 5"):
        build(spark, ["no:id\ttitle\n5\tOak\n5\tElm"], NO_RELS)
    with pytest.raises(ValueError, match="several nodes with id 5"):
        build(spark, ["no:id\ttitle\n5\tOak", "no:id\n5"], NO_RELS)
    with pytest.raises(ValueError, match="several nodes with id 0"):
        build(spark, ["no:id\ttitle\n0\tOak"], NO_RELS, earlier=build(spark, ["title\nElm"], NO_RELS)[0])
    with pytest.raises(Exception, match="no id in row 2"):
        build(spark, ["no:id\ttitle\n5\tOak\n\tElm"], NO_RELS)[0].nodes.collect()
    assert node_rows(build(spark, ["no:id\ttitle\n5\tOak\n\t\n\tElm"], NO_RELS)[0]) == [(5, [], {"title": "Oak"})]  # nothing is read after the blank row


@pytest.mark.parametrize(
    "kind,stored,asked",
    [
        ("double", ["1", "2.50", "1e3"], ["1.0", "2.5", "1000"]), ("int", ["1", "20", "-3"], ["01", "+20", "-003"]), ("boolean", ["TRUE", "no"], ["true", "x"]), ("char", ["abc", "d"], ["a", "dx"]),
        ("int_array", ["1,2", "3"], ["01,+2", "3"]), ("string_array", ["a,b", "c"], ["a,b,,", "c"]),
    ],
)
def test_lookup_is_by_value(spark, kind, stored, asked):
    nodes = [f"w:{kind}:users\n" + "\n".join(stored)]
    g, counts = build(spark, nodes, [f"w:{kind}:users\tend:int\ttype\n" + "\n".join(f"{x}\t0{i}\tT" for i, x in enumerate(asked))])
    assert rel_rows(g) == [(i, i, i, "T") for i in range(len(asked))] and counts.first().skipped == 0
    if kind == "int":
        with pytest.raises(Exception, match="Error converting value row 1 column 0"):
            build(spark, nodes, ["w:int:users\tend\ttype\nx\t1\tT"])[0].relationships.collect()


def test_no_files_and_only_relationships(spark, tmp_path):
    path = str(tmp_path / "g")
    build(spark, ["name:string:users\nA\nB"], [])[0].write(path)
    g, counts = build(spark, [], ["name:string:users\tname:string:users\ttype\nA\tB\tT"], earlier=Graph.read(spark, path))
    assert counts.first().imported == 1
    g.write(path, keep=True)
    both = Graph.read(spark, path)
    assert rel_rows(both) == [(0, 0, 1, "T")] and both.nodes.count() == 2
    build(spark, [], [])[0].write(path)
    assert Graph.read(spark, path).nodes.count() == 0 and Graph.read(spark, path).index.count() == 0


def test_fulltext_index(spark, tmp_path):
    path = str(tmp_path / "g")
    specs = [IndexSpec("node_index", "users"), IndexSpec("node_index", "texts", "fulltext"), IndexSpec("relationship_index", "notes", "fulltext")]
    nodes = ["name:string:users\tabout:string:texts\nA\tThe old mill, the OLD bridge\nB\tA new bridge\nC\t"]
    g, _ = build(spark, nodes, ["name:string:users\tend\ttype\tn:string:notes\nA\t1\tT\tSold in May"], specs)
    g.write(path)
    stored = Graph.read(spark, path)
    ids = lambda *a: sorted(r.entity_id for r in search(stored.tokens, *a).collect())
    assert ids("texts", "about", "bridge") == [0, 1] and ids("texts", "about", "Old Bridge") == [0] and ids("texts", "about", "-") == [] and ids("notes", "n", "may") == [0]
    assert stored.tokens.where("index_name = 'users'").count() == 0 and stored.tokens.where("entity_id = 0 and token = 'old'").count() == 1
    assert index_get(stored.index, "texts", "about", "A new bridge").count() == 1  # exact entries stay


def test_lookup_literal_and_unresolved(spark):
    nodes = ["name:string:users\nA\nB"]
    g, counts = build(spark, nodes, ["name:string:users\tend\ttype\tw:float\nA\t123\tT\t1.5\nX\t1\tT\t\nB\t-1\tT\t\n\t5\tT\t\nB\t7\tU\t"])
    assert rel_rows(g) == [(0, 0, 123, "T"), (1, 1, 7, "U")] and counts.first().asDict() == {"imported": 2, "skipped": 3}
    assert dangling(g.relationships, g.nodes).count() == 2
    g, counts = build(spark, nodes, ["name:string:users\tname:string:users\ttype\nA\tA\tT\nA\tC\tT\nC\tA\tT"])
    assert rel_rows(g) == [(0, 0, 0, "T")]
    assert index_get(g.index, "users", "name", "B").collect()[0].entity_id == 1


def test_ambiguous_keys_fail_only_when_probed(spark):
    nodes = ["name:string:users\nA\nA\nB"]
    assert rel_rows(build(spark, nodes, ["name:string:users\tend\ttype\nB\t1\tT"])[0]) == [(0, 2, 1, "T")]
    with pytest.raises(Exception, match="several entries of name A"):
        build(spark, nodes, ["name:string:users\tend\ttype\nA\t1\tT"])[0].relationships.collect()


def test_bad_endpoint_missing_type_and_unconfigured_index(spark):
    with pytest.raises(Exception, match="start is no id: x"):
        build(spark, ["a\n1"], ["start\tend\ttype\nx\t1\tT"])
    with pytest.raises(Exception, match="relationship without type"):
        build(spark, ["a\n1"], ["start\tend\ttype\n0\t1\t"])[0].relationships.collect()
    g, counts = build(spark, ["name:string:users\nA"], ["name:string:users\tend\ttype\nX\t1\t"])
    assert counts.first().skipped == 1 and g.relationships.count() == 0  # the skip comes before the type is asked for
    with pytest.raises(ValueError, match="isn't configured"):
        build(spark, ["a:string:nope\n1"], NO_RELS)


def test_relationship_index_and_index_file(spark):
    specs = [*USERS, IndexSpec("relationship_index", "since")]
    extra = file(spark, "id\tlanguage\n0\tFrisian\n1\t")
    g, _ = build(spark, ["name:string:users\nA\nB"], ["start\tend\ttype\ty:int:since\n0\t1\tT\t7\n1\t0\tT\t"], specs, index_files={"users": [extra, file(spark, "id\tcolour:int\n1\t07")]})
    got = sorted((r.index_name, r.entity_id, r.property, r.value) for r in distinct_entries(g.index.unionByName(g.index)).collect())
    assert got == [("since", 0, "y", "7"), ("users", 0, "language", "Frisian"), ("users", 0, "name", "A"), ("users", 1, "colour", "7"), ("users", 1, "name", "B")]


def test_write_replace_keep(spark, tmp_path):
    path = str(tmp_path / "g")
    build(spark, ["name:string:users\nA\nB"], ["name:string:users\tend\ttype\nA\t1\tT"])[0].write(path)
    earlier = Graph.read(spark, path)
    g, _ = build(spark, ["name:string:users\nC"], ["name:string:users\tname:string:users\ttype\nA\tC\tT"], earlier=earlier)
    g.write(path, keep=True)
    both = Graph.read(spark, path)
    assert [r.id for r in both.nodes.orderBy("id").collect()] == [0, 1, 2] and rel_rows(both) == [(0, 0, 1, "T"), (1, 0, 2, "T")]
    build(spark, ["name:string:users\nZ"], NO_RELS)[0].write(path)
    assert Graph.read(spark, path).nodes.count() == 1 and glob.glob(f"{path}-*") == []


def test_failed_load_leaves_the_target(spark, tmp_path):
    path = str(tmp_path / "g")
    build(spark, ["a:int\n1"], NO_RELS)[0].write(path)
    with pytest.raises(Exception, match="Error converting"):
        build(spark, ["a:int\nx"], NO_RELS)[0].write(path)
    assert Graph.read(spark, path).nodes.count() == 1 and not [x for x in glob.glob(f"{path}*") if x.endswith("-old")]


def test_cli(spark, tmp_path):
    (tmp_path / "n1.csv").write_text("name:string:users\tage\tworks_on\nMichael\t37\tx\nSelina\t14")
    (tmp_path / "n2.csv").write_text("name:string:users\tage\tworks_on\nRana\t6\nSelma\t4")
    (tmp_path / "r.csv").write_text("name:string:users\tname:string:users\ttype\tsince\tcounter:int\nMichael\tSelina\tFATHER_OF\t1998-07-10\t1\nMichael\tNobody\tFATHER_OF\t\t\nRana\tSelma\tSISTER_OF 2008-05-03\t5")
    config = LoadConfig.from_args([str(tmp_path / "g"), f"{tmp_path}/n1.csv,{tmp_path}/missing,{tmp_path}/n2.csv", str(tmp_path / "r.csv"), "node_index", "users", "exact"])
    seen = run(spark, config)
    assert (seen["nodes"], seen["relationships"], seen["skipped"]) == (4, 2, 1)
    assert list(seen["phases"]) == ["reading", "planning", "nodes", "relationships", "index"]
    rels = Graph.read(spark, config.graph).relationships.orderBy("id").collect()
    assert (rels[1].type, rels[1].props.since, rels[1].props.counter) == ("SISTER_OF 2008-05-03", "5", None)


def test_cli_separator_pattern_and_index_files_of_several_headers(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name:string:users\tt:string_array\nA\tx;y:z\n")
    (tmp_path / "i.csv").write_text("id\tp\n0\tone")
    (tmp_path / "j.csv").write_text("id\tq:int\n0\t2")
    (tmp_path / "x.properties").write_text(f"batch_array_separator=[;:]\nbatch_import.nodes_files={tmp_path}/n.csv\nbatch_import.graph_db={tmp_path}/g\nbatch_import.node_index.users=fulltext:{tmp_path}/i.csv,{tmp_path}/none,{tmp_path}/j.csv\n")
    seen = run(spark, LoadConfig.from_args([str(tmp_path / "x.properties")]))
    got = Graph.read(spark, f"{tmp_path}/g")
    assert (seen["nodes"], seen["relationships"], seen["skipped"]) == (1, 0, 0) and got.nodes.first().props.t == ["x", "y", "z"]
    assert sorted((r.property, r.value) for r in got.index.collect()) == [("name", "A"), ("p", "one"), ("q", "2")] and search(got.tokens, "users", "p", "ONE").count() == 1


def test_phases_tell_of_tasks(spark, caplog):
    report = Phases(spark, 0.05)
    with caplog.at_level("INFO", "weftgraph"):
        with report.phase("rows"):
            spark.range(0, 4000, 1, 8).selectExpr("sum(length(repeat(cast(id as string), 20000)))").collect()
            time.sleep(0.2)
        report.count("rows", 4000)
    assert report.rows == {"rows": 4000} and any("of 8 tasks" in r.message for r in caplog.records) and any("4000 rows" in r.message for r in caplog.records)


def test_ids_are_dense_in_order(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "cast(id % 3 as int) as f")
    got = assign_ids(df, ["f", "k"], 5).orderBy("id").collect()
    assert [r.id for r in got] == list(range(5, 1005)) and [(r.f, r.k) for r in got] == sorted((r.f, r.k) for r in got)
    assert assign_ids(df.where("false"), ["k"]).count() == 0 and next_id(spark.createDataFrame([], "id bigint")) == 0


@pytest.mark.parametrize("left_out,shuffles", [("false", 0), ("line_no % 3000 between 7 and 9", 0), ("file_no = 2 or line_no between 1 and 5000", 0), ("line_no % 3 = 0", 1), ("true", 0)])
def test_ids_by_line_number(spark, left_out, shuffles):
    lines = spark.range(1, 20_001).selectExpr("cast(1 + id % 3 as int) as file_no", "cast((id + 2) div 3 as bigint) as line_no").where(f"not ({left_out})")
    got = number_by_line(lines, 6667, 5, unique=True)
    rows = [tuple(r) for r in got.orderBy("id").select("id", "file_no", "line_no").collect()]
    assert [r[0] for r in rows] == list(range(5, 5 + lines.count())) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles


def test_sort_file(spark, tmp_path):
    src = tmp_path / "r.csv"
    src.write_text("start\tend\t\n" + "".join(f"{i}\t{j}\t\n" for i in range(9, -1, -1) for j in range(9, -1, -1)))
    sort_file(spark, str(src), str(tmp_path / "out"))
    lines = [x for p in sorted(glob.glob(f"{tmp_path}/out/part-*")) for x in open(p).read().splitlines()]
    keys = [(min(a, b), max(a, b)) for a, b in (map(int, x.split("\t")[:2]) for x in lines[1:])]
    assert lines[0] == "start\tend\t" and keys == sorted(keys) and len(keys) == 100
    assert [x for x in lines if x.startswith(("2\t1\t", "1\t2\t"))] == ["2\t1\t", "1\t2\t"]  # equal pairs by line number


@pytest.mark.parametrize("make", [generate.random_graph, generate.sorted_graph])
def test_generated_graphs_load(spark, tmp_path, make):
    nodes, rels = make(spark, 200, 5, ["A", "B", "C"])
    assert sorted(map(tuple, make(spark, 200, 5, ["A", "B", "C"])[1].collect())) == sorted(map(tuple, rels.collect()))
    generate.write_files(nodes, rels, str(tmp_path))
    parts = [read_cells(spark, sorted(p for p in glob.glob(f"{tmp_path}/{k}/part-*") if os.path.getsize(p))) for k in ("nodes", "rels")]
    g, counts = load(spark, *parts, [])
    assert g.nodes.count() == 200 and counts.first().asDict() == {"imported": rels.count(), "skipped": 0}
    assert g.relationships.where("start between 0 and 199 and end between 0 and 199").count() == rels.count()


def test_ring(spark):
    nodes, rels = generate.ring_graph(spark, 5, [1, 4])
    assert nodes.count() == 5 and sorted((r.start, r.end) for r in rels.collect()) == sorted((i, (i + o) % 5) for i in range(5) for o in (1, 4))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fields = header_of("a:int\tb")
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"{k}\tx\n\n{k + 10}\n")
        append_stream(stream_rows(spark, str(tmp_path / "in"), fields), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.a, r.b) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "x"), (1, "x"), (10, None), (11, None)]


def test_stream_into_a_graph(spark, tmp_path):
    (tmp_path / "in").mkdir()
    fields, path = header_of("name:string:users\tage:int"), str(tmp_path / "g")
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"A{k}\t{k}\n\nB{k}\t\n")
        append_nodes(spark, str(tmp_path / "in"), fields, USERS, path, str(tmp_path / "cp")).awaitTermination()
    g = Graph.read(spark, path)
    assert sorted(r.id for r in g.nodes.collect()) == [0, 1, 2, 3] and sorted(r.props.name for r in g.nodes.collect()) == ["A0", "A1", "B0", "B1"]
    assert index_get(g.index, "users", "name", "B1").count() == 1
    build(spark, ["name:string:users\nX"], NO_RELS)[0].write(path, keep=True, name="batch1")  # a batch that is run again
    assert Graph.read(spark, path).nodes.count() == 4
