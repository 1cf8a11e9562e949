import pytest

from weftgraph.config import ConfigError, LoadConfig, NamedArgs, read_properties
from weftgraph.operators.index import IndexSpec
from weftgraph.schema import HeaderError, has_explicit_ids, header_of, label_field, parse_header, to_struct


def test_header_cells():
    f = parse_header(["name:string:users", "age:INT", ":label", "plain"])
    assert [(x.name, x.type, x.index) for x in f] == [("name", "STRING", "users"), ("age", "INT", None), ("", "LABEL", None), ("plain", "STRING", None)]
    assert str(f[1]) == "1. age type: INT"


def test_unknown_type():
    with pytest.raises(HeaderError, match="Unknown Type date"):
        parse_header(["a:date"])


def test_last_label_counts_and_name_alone_is_no_label():
    assert label_field(parse_header(["x:label", "y:label", "a"])).name == "y"
    assert label_field(parse_header(["label"])) is None


def test_explicit_ids_only_in_first_column():
    assert has_explicit_ids(header_of("i:id\ta"))
    assert not has_explicit_ids(header_of("a\ti:id"))
    assert to_struct(header_of("a\ti:id\tb:int")).simpleString() == "struct<a:string,b:int>"


def test_index_spec_round_trip():
    for value in ("exact", "exact:nodes.csv"):
        assert IndexSpec.from_entry("batch_import.node_index.foo", value).value == value
    assert IndexSpec.from_entry("batch_import.csv.quotes", "true") is None
    for bad in (("node_index", "foo", "bar"), ("foo", "exact", "exact")):
        with pytest.raises(ValueError):
            IndexSpec(*bad)


def test_args_and_file(tmp_path):
    p = tmp_path / "x.properties"
    p.write_text("# c\nbatch_import.graph_db=fromfile\nbatch_import.csv.quotes=FALSE\nbatch_import.node_index.users=exact\n")
    c = LoadConfig.from_args([str(p), "cli.db", "n.csv", "r.csv", "node_index", "users", "fulltext", "u.csv"])
    assert (c.graph, c.nodes, c.rels, c.quotes) == ("fromfile", "n.csv", "r.csv", False)  # the file wins for paths, the arguments for indexes
    assert c.indexes == [IndexSpec("node_index", "users", "fulltext", "u.csv")]
    assert read_properties(str(tmp_path / "none")) == {}


def test_bad_settings():
    with pytest.raises(ConfigError, match="missing"):
        LoadConfig.from_args([])
    with pytest.raises(ConfigError):
        LoadConfig.from_args(["g", "n", "r", "node_index", "x"])
    with pytest.raises(ValueError, match="nodes and for relationships"):
        LoadConfig.from_args(["g", "n", "r", "node_index", "x", "exact", "relationship_index", "x", "exact"])


def test_tab_and_other_delimiters():
    base = {"batch_import.graph_db": "g"}
    assert LoadConfig.from_settings(base).delim == "\t"
    assert LoadConfig.from_settings(base | {"batch_import.csv.delim": "\t"}).delim == "\t"
    assert LoadConfig.from_settings(base | {"batch_import.csv.delim": " ; "}).delim == ";"
    assert not LoadConfig.from_settings(base | {"batch_import.keep_db": "yes"}).keep


def test_named_args():
    a = NamedArgs(["x.csv", "7"], "File", "count")
    assert (a.text("file"), a.number("COUNT"), a.invalid) == ("x.csv", 7, False)
    assert NamedArgs([], "a").invalid
    for args, name in (([], "a"), (["1"], "b")):
        with pytest.raises(ConfigError):
            NamedArgs(args, "a").text(name)
