import gzip
import io
import random
import re
import zipfile
from contextlib import contextmanager

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from weftgraph.operators.rows import typed_rows
from weftgraph.sources.cells import numbered_lines, quoted_records, read_cells, records, split_record, usable_paths


def read(spark, path, delim="\t", quotes=True):
    f = read_cells(spark, [str(path)], delim, quotes)[0]
    return f.fields, [r.cells for r in f.rows.orderBy("line_no").collect()]


@pytest.mark.parametrize("quotes", [True, False])
def test_plain_file_and_crlf(spark, tmp_path, quotes):
    p = tmp_path / "a.csv"
    p.write_bytes("a,b,c:int\r\n1,2,3\r\n\r\n4,5,6".encode())
    fields, rows = read(spark, p, ",", quotes)
    assert fields[2].type == "INT" and rows == [["1", "2", "3"]]  # the blank line ends the file
    p.write_bytes("a,b,c:int\r\n1,2,3\r\n,5\r\n4,5,6".encode())
    assert read(spark, p, ",", quotes)[1] == [["1", "2", "3"], ["", "5"], ["4", "5", "6"]]


def test_non_ascii(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("größe:int\t名前\n7\tÆsir 漢字\n8\t\U0001f332", encoding="utf-8")
    fields, rows = read(spark, p)
    assert [(f.name, f.type) for f in fields] == [("größe", "INT"), ("名前", "STRING")] and rows == [["7", "Æsir 漢字"], ["8", "\U0001f332"]]


def test_quoted_file(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('"a"\tb\tc\n"1\n2"\t2\t3\n"x""y"\t"\\""\t""\n\nlast\t', encoding="utf-8")
    fields, rows = read(spark, p)
    assert fields[0].name == "a"
    assert rows == [["1\n2", "2", "3"], ['x"y', '"', ""]]  # the blank record ends the file
    f = read_cells(spark, [str(p)])[0]
    assert typed_rows(f.rows, f.fields).where("line_no = 2").first().props.c is None


def test_gzip_and_zip(spark, tmp_path):
    text = 'a\tb\n1\t"2"\n3\t4\n'
    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(text.encode()))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.csv", text)
    for name in ("x.csv.gz", "x.zip"):
        assert read(spark, tmp_path / name)[1] == [["1", "2"], ["3", "4"]]
    assert read(spark, tmp_path / "x.csv.gz", quotes=False)[1] == [["1", '"2"'], ["3", "4"]]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("a\tb")
    assert read(spark, tmp_path / "h.csv")[1] == []
    assert read(spark, tmp_path / "e.csv")[1] == []


def test_files_of_one_header_share_a_scan(spark, tmp_path):
    texts = ["a\tb\n1\t2\n\n9\t9\n", "a\n5\n", "a\tb\n3\t4\n5\t6", 'a\tb\n"7"\t8', "a\tb"]
    paths = []
    for i, t in enumerate(texts):
        paths.append(str(tmp_path / f"f {i}.csv"))
        (tmp_path / f"f {i}.csv").write_text(t)
    files = read_cells(spark, paths)
    got = sorted((r.file_no, r.line_no, r.cells) for f in files for r in f.rows.collect())
    assert got == [(1, 1, ["1", "2"]), (2, 1, ["5"]), (3, 1, ["3", "4"]), (3, 2, ["5", "6"]), (4, 1, ["7", "8"])]
    assert {k: v for f in files for k, v in f.kept.items()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 0} and len(files) == 3


def test_missing_files_are_skipped(tmp_path):
    p = tmp_path / "there.csv"
    p.write_text("a")
    assert usable_paths(f",foo,{p},{tmp_path}") == [str(p)] and usable_paths(None) == []


def test_lines_are_numbered_in_file_order_over_blocks(spark, tmp_path):
    p = tmp_path / "many.txt"
    p.write_text("".join(f"{i}\n" for i in range(50_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        lines = numbered_lines(spark, str(p))
        assert lines.rdd.getNumPartitions() > 1
        assert lines.where("cast(value as bigint) = line_no").count() == 50_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


CELL = st.text(alphabet='ab"\\\t\n é', max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=5))
def test_quoted_round_trip(rows):
    quote = lambda c: '"' + c.replace("\\", "\\\\").replace('"', '""') + '"'
    text = "\n".join("\t".join(map(quote, r)) for r in rows)
    assert list(records(io.StringIO(text), "\t")) == rows


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab"\\\t\n\r', max_size=25))
def test_lines_join_to_the_records_of_a_state_machine(text):
    """Against a plain reading character by character."""
    rows, row, cell, quoted, fresh, i = [], [], "", False, True, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\" and i + 1 < len(text):
            cell, i = cell + text[i + 1], i + 1
        elif quoted and text[i : i + 2] == '""':
            cell, i = cell + '"', i + 1
        elif quoted and c == '"':
            quoted = False
        elif quoted or c not in '"\t\n' or (c == '"' and not fresh):
            cell += c
            fresh = False
        elif c == '"':
            quoted, fresh = True, False
        else:
            row, cell, fresh = [*row, cell], "", True
            if c == "\n":
                rows, row = [*rows, row], []
        i += 1
    assume(not (quoted and text.endswith("\n")))  # a line feed at the very end isn't read as part of a cell that is still open
    if text and not (text.endswith("\n") and not quoted and not row and not cell and fresh):
        rows.append([*row, cell])
    got = list(records(io.StringIO(text), "\t"))
    strip = lambda rs: [[c.rstrip("\r") for c in r] for r in rs]
    assert strip(got) == strip(rows)


@pytest.mark.parametrize("block", ["90b", "15b", "1m"])
def test_quoted_records_across_blocks(spark, tmp_path, block):
    paths, want = [], []
    for k in range(3):
        rows = [[f"{k}/{i}", 'x"' * (i % 5), "long\n" * (i * 7 % 23), "a\\b" if i % 3 else ""] for i in range(15)]
        quote = lambda c: '"' + c.replace("\\", "\\\\").replace('"', '""') + '"' if set(c) & set('"\n\\') else c
        paths.append(str(tmp_path / f"q{k}.csv"))
        (tmp_path / f"q{k}.csv").write_text("a\tb\tc\td\n" + "\n".join("\t".join(map(quote, r)) for r in rows) + ('\n"open\nto the end' if k == 1 else ""))
        want += [(k + 1, i + 1, r) for i, r in enumerate(rows)] + ([(2, 16, ["open\nto the end"])] if k == 1 else [])
    with blocks_of(spark, block):
        got = sorted((r.file_no, r.line_no, r.cells) for f in read_cells(spark, paths) for r in f.rows.collect())
    assert got == want


@contextmanager
def blocks_of(spark, size):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], size)
    spark.conf.set(keys[1], "1b")
    try:
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def until_blank(rows, width):
    for i, row in enumerate(rows):
        if not "".join(row[:width]):
            return rows[:i]
    return rows


@pytest.mark.parametrize("block", ["7b", "40b", "1m"])
def test_any_texts_in_any_blocks(spark, tmp_path, block):
    """Against reading line by line: blank records, quotes that open and close in other blocks, or never."""
    rng = random.Random(block)
    paths, want = [], []
    for k in range(30):
        text = "".join(rng.choice(['a"', '"b', '""', '"', "c", "\t", "\n", "\n", "\\", "\r\n", 'd\t"e\nf"\n', "g\n"]) for _ in range(40))
        paths.append(str(tmp_path / f"r{k:02}.csv"))
        (tmp_path / f"r{k:02}.csv").write_bytes(("x\ty\n" + text).encode())
        rows = list(records(io.StringIO("x\ty\n" + text, newline=""), "\t"))[1:]
        want += [(k + 1, i, row) for i, row in enumerate(until_blank(rows, 2), 1)]
    with blocks_of(spark, block):
        files = read_cells(spark, paths)
        got = sorted((r.file_no, r.line_no, r.cells) for f in files for r in f.rows.collect())
    assert got == want and sum(sum(f.kept.values()) for f in files) == len(want)


def test_quote_that_is_never_closed(spark, tmp_path):
    p = tmp_path / "open.csv"
    p.write_text("x\ty\n1\t2\n3\t\"4\n" + "line of a cell that nobody closed\n" * 200)
    with blocks_of(spark, "500b"):
        with pytest.raises(ValueError, match=r"open\.csv: record 2 has \d+ characters; is a quote never closed"):
            quoted_records(spark, [str(p)], [1], "\t", 2, most=5000)
        assert quoted_records(spark, [str(p)], [1], "\t", 2).rows.count() == 3


def test_blank_form():
    from weftgraph.sources.cells import blank_form

    for line in ("", '""', "\t", '""\t""', "\t\tx", '\t""\r', "\r", "x", '"', "\tx", '""x', '"" ""', "\t\t"):
        cells = split_record(line, "\t")
        assert bool(re.match(blank_form("\t", 2).replace("\\z", "\\Z"), line)) == (not "".join(cells[:2])) or line == '"', line
