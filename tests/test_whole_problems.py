"""Problem queries do the whole of their problem, over small tables of their own."""

from datetime import datetime

import pytest

from weftgraph.plans import problems

AT = datetime(2025, 1, 1)
HEADER = "name:string:users\tage\tworks_on"


@pytest.fixture
def folder(spark, tmp_path):
    tables = {
        "raw_files": ([(1, "nodes", "\t", HEADER, "f", AT)], "file_no int, series string, delim string, header string, file_name string, arrived_at timestamp_ntz"),
        "raw_lines": ([(1, 1, 1, "A\t7\tx"), (2, 1, 2, "A\tx")], "line_id bigint, file_no int, line_no bigint, line string"),
        "nodes": (
            [(1, 1, "A", "7", "x", AT, None), (2, 1, None, "9x", None, AT, AT), (3, 1, "B", "", "y", AT, AT)],
            "row_id bigint, load_no int, `name:string:users` string, age string, works_on string, loaded_at timestamp_ntz, deleted_at timestamp_ntz",
        ),
        "rels": (
            [(1, 1, "A", "B", "T", "", "5", AT), (2, 1, " ", None, "T", "", "5", AT), (3, 2, "A", "", "T", "", "5", AT), (4, 2, "A", "B", "T", "1", " 5", AT)],
            "row_id bigint, load_no int, c0 string, c1 string, c2 string, c3 string, c4 string, loaded_at timestamp_ntz",
        ),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_p1_has_reasons_and_rows_of_every_table(spark, folder):
    reasons = {(r.tbl, r.row_key): (r.rule, r.edits, r.cells) for r in problems.p1_reasons(spark, folder).collect()}
    assert reasons == {
        ("raw_lines", 2): ("value", "age is no int", ["A", "x"]),
        ("nodes", 2): ("value", "age is no int", ["9x"]),
        ("rels", 2): ("value", "c0 is no key; c1 is no key", [" ", None]),
        ("rels", 3): ("value", "c1 is no key", [""]),
    }
    assert set(reasons) == {(r.tbl, r.row_key) for r in problems.p1_found(spark, folder).collect()}
    loaded = {(r.tbl, r.row_key): r for r in problems.p1_loaded(spark, folder).collect()}
    assert set(loaded) == {("raw_lines", 1), ("nodes", 1), ("nodes", 3), ("rels", 1), ("rels", 4)}
    assert [c.field for c in loaded["nodes", 1].cells] == ["name", "age", "works_on"] and loaded["nodes", 1].cells[1].whole == 7
    assert loaded["nodes", 3].cells[1].text is None and (loaded["nodes", 3].load_no, loaded["nodes", 3].deleted_at) == (1, AT)
    assert loaded["rels", 1].cells[4].whole == 5 and (loaded["rels", 4].cells[4].text, loaded["rels", 4].cells[4].whole) == (" 5", None)
