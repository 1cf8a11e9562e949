import pytest
from pyspark.sql import functions as F

from weftgraph.functions import util
from weftgraph.functions.cells import as_day, as_int, is_key
from weftgraph.functions.convert import convert, split_array, split_labels
from weftgraph.operators.rows import conversion_errors, property_count, stop_at_blank, typed_rows, union_rows
from weftgraph.schema import HeaderError, header_of

CELLS = "file_no int, line_no bigint, cells array<string>"


def cells(spark, *lines, file_no=1):
    return spark.createDataFrame([(file_no, i, x.split("\t")) for i, x in enumerate(lines, 1)], CELLS)


def props(spark, header, *lines, **kw):
    return [r.props.asDict() for r in typed_rows(cells(spark, *lines), header_of(header), **kw).orderBy("line_no").collect()]


def test_types(spark):
    assert props(spark, "a:int\tb:float\tc:float", "10\t10.0\t1E+10") == [{"a": 10, "b": 10.0, "c": 1e10}]
    got = props(spark, "a:boolean\tb:byte\tc:short\td:long\te:char\tf:double", "yes\t127\t-5\t+7\txyz\t10.5", "TRUE\t\t\t\t\t")
    assert got[0] == {"a": False, "b": 127, "c": -5, "d": 7, "e": "x", "f": 10.5}
    assert got[1] == {"a": True, "b": None, "c": None, "d": None, "e": None, "f": None}


def test_arrays(spark):
    got = props(spark, "a:STRING_ARRAY\tb:int_array\tc:boolean_array", "10,11,12\t1,2,3\ttrue,false,true")
    assert got == [{"a": ["10", "11", "12"], "b": [1, 2, 3], "c": [True, False, True]}]
    assert props(spark, "a:string_array", "10%11", separator="%") == [{"a": ["10", "11"]}]
    row = spark.range(1).select(*[split_array(F.lit(x)).alias(f"c{i}") for i, x in enumerate((",", ",A", "a,b,,", "a|b"))], split_array(F.lit("a|b"), "|", True).alias("r")).first()
    assert (row.c0, row.c1, row.c2, row.c3) == ([], ["", "A"], ["a", "b"], ["a|b"])
    assert row.r == ["a", "|", "b"]


def test_labels(spark):
    row = spark.range(1).select(split_labels(F.lit(" bar , bor,, ")).alias("a"), split_labels(F.lit("  ")).alias("b")).first()
    assert row.a == ["bar", "bor"] and row.b == [""]
    r = typed_rows(cells(spark, "P\tQ\tv", "P\t\tv"), header_of("x:label\ty:label\ta")).orderBy("line_no").collect()
    assert [x.labels for x in r] == [["Q"], None] and r[0].props.asDict() == {"a": "v"}


@pytest.mark.parametrize("kind,bad", [("int", "foo"), ("int", " 1"), ("int", "2147483648"), ("int", "1 "), ("int", "12.5"), ("int", ".5"), ("int", "12."), ("int", "1e3"), ("int", "+"), ("int", "1\n"), ("int", "--1"), ("int", "0x1"), ("long", "9223372036854775808"), ("int", "١"), ("byte", "128"), ("double", "x"), ("int_array", "1,,2"), ("char_array", "a,,b"), ("id", "x")])
def test_bad_cells_abort(spark, kind, bad):
    with pytest.raises(Exception, match=rf"Error converting value row 1 column 1\. b type: {kind.upper()} value"):
        _convert_b(spark, kind, bad)


def _convert_b(spark, kind, bad):
    field = header_of(f"a\tb:{kind}")[1]
    cells(spark, f"2\t{bad}").select(convert(F.get("cells", F.lit(1)), field, F.col("line_no"))).collect()


def test_ragged_and_empty_cells(spark):
    for line, want in [("\t2\t3", (None, "2", "3")), ("\t2\t", (None, "2", None)), ("1\t\t", ("1", None, None)), ("", (None, None, None)), ("1", ("1", None, None)), ("1\t2", ("1", "2", None)), ("1\t2\t3\t4", ("1", "2", "3"))]:
        assert tuple(props(spark, "a\tb\tc", line)[0].values()) == want


def test_stop_at_blank_row_per_file_and_unread_rows_dont_convert(spark):
    both = cells(spark, "x", "", "y").unionByName(cells(spark, "1", "2", file_no=2))
    kept = stop_at_blank(both, 1)
    assert sorted((r.file_no, r.line_no) for r in kept.collect()) == [(1, 1), (2, 1), (2, 2)]
    bad = stop_at_blank(cells(spark, "1", "", "foo"), 1)
    assert [r.props.a for r in typed_rows(bad, header_of("a:int")).collect()] == [1]
    assert stop_at_blank(cells(spark, "1").where("false"), 1).count() == 0


def test_repeated_names_last_filled_wins(spark):
    assert props(spark, "a\ta", "1\t2", "1\t") == [{"a": "2"}, {"a": "1"}]


def test_offset_type_and_count(spark):
    rows = typed_rows(cells(spark, "1\t2\tT\tfoo\t"), header_of("start\tend\ttype\ta\tb"), 3)
    r = rows.select("cell_type", "props", property_count(rows).alias("n")).first()
    assert (r.cell_type, r.props.asDict(), r.n) == ("T", {"a": "foo", "b": None}, 1)
    assert typed_rows(cells(spark, "s\te\tq\tKNOWS"), header_of("s\te\tx\tt:label"), 3).first().cell_type == "KNOWS"


def test_legacy(spark):
    r = typed_rows(cells(spark, "  \tA,B"), header_of("a\ttype"), legacy=True).first()
    assert r.props.a is None and r.labels == ["A", "B"] and r.props.type == ["A", "B"]


def test_union_and_clash(spark):
    one, two = typed_rows(cells(spark, "1"), header_of("a:int")), typed_rows(cells(spark, "x", file_no=2), header_of("b"))
    assert [r.props.asDict() for r in union_rows([one, two]).orderBy("file_no").collect()] == [{"a": 1, "b": None}, {"a": None, "b": "x"}]
    clash = typed_rows(cells(spark, "x", file_no=2), header_of("a"))
    with pytest.raises(HeaderError, match="different types"):
        union_rows([one, clash])
    mixed = union_rows([one, clash], "variant").select(F.schema_of_variant("props.a").alias("t"))
    assert sorted(r.t for r in mixed.collect()) == ["BIGINT", "STRING"]


def test_conversion_errors(spark):
    got = conversion_errors(cells(spark, "1\tx", "y\t", "3\t4"), header_of("a:int\tb:int")).orderBy("line_no").collect()
    assert [(r.line_no, r.position, r.name, r.value) for r in got] == [(1, 1, "b", "x"), (2, 0, "a", "y")]


def test_cell_predicates(spark):
    values = ["A", "", None, "  ", "a\tb", "x\ufffd", 'a"b', 'a"b"', "\x7f", "ok \u00a0"]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", is_key(F.col("v")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [True, False, False, False, False, False, False, True, False, True]
    row = spark.range(1).select(as_int(F.lit("+007")).alias("a"), as_int(F.lit("2147483648")).alias("b"), as_int(F.lit("1\n")).alias("c"), as_day(F.lit("2024-02-30")).alias("d"), as_day(F.lit("0000-01-01")).alias("e"), as_int(F.lit("0" * 50 + "7")).alias("f")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (7, None, None, None, None, 7)


def test_util(spark):
    arrays = [[1, 2, -1], [-1, -1], [], None, [3, -1, 4]]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>").select("i", util.logical_size(F.col("a")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [2, 2, 0, 0, 3]
    with pytest.raises(Exception, match="nothing to join"):
        spark.range(1).select(util.join(F.array().cast("array<string>"), ",")).collect()
