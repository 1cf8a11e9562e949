import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from weftgraph.operators.error_parse import cheapest, fits, key_ok, parse_record, parse_records, scan, typed_cells

NODES, RELS = "name:string:users\tage\tworks_on", "name:string:users\tname:string:users\ttype\tsince\tcounter:int"


def rule(line, series="nodes", header=NODES, delim="\t"):
    return parse_record(line, series, header, delim).rule


@pytest.mark.parametrize(
    "line,want",
    [
        ("A\t1\tx", None), ("A\t1", None), ("A\t1\tx\r", None), ("A", "count"), ("A\t1\tx\ty", "count"), ("", "count"), ("A\tx\ty", "value"), ("A\t2147483648\t", "value"),
        ('"A\tB"\t1\tx', None), ('"A""B"\t1\tx', None), ('"A\\"B"\t1', None), ('"A\nB"\t1', None), ('A"\t1\tx', "quoting"), ('"A\t1\tx', "quoting"), ('"A"x\t1\ty', "quoting"), ('"A\\', "quoting"),
        ('""\t""\t""', None), ('"""\t1\tx', "quoting"), ('""""\t1\tx', None), ("A\t\tx", None), ('A\t" 1"\tx', "value"), (None, "null"), ("A\t1\n\tx", "value"), ("A\t1\t\r\r", None),
    ],
)
def test_rules_of_nodes(line, want):
    assert rule(line) == want


@pytest.mark.parametrize("line,want", [("A\tB\tT\t\t1", None), ("A\tB\tT\t\t", None), ("A\tB\tT\t", "count"), ("\tB\tT\t\t1", "value"), ("  \tB\tT\t\t1", "value"), ('"A\tx"\tB\tT\t\t1', "value"), ('"a""b"\tB\tT\t\t1', "value"), ("A\x7f\tB\tT\t\t1", "value"), ("A\tB\tT\t\t1.5", "value")])
def test_rules_of_rels(line, want):
    assert rule(line, "rels", RELS) == want


def test_types():
    assert all(fits(v, "double") for v in ("1", "-1.5", "1.0E+10", "2e5", "+3")) and not any(fits(v, "float") for v in (".5", "5.", "0x1F", "NaN", " 1", "1f", "١"))
    assert fits("9223372036854775807", "long") and not fits("9223372036854775808", "long") and fits("-" + "0" * 5000 + "1", "int") and not fits("1" * 5000, "int")
    assert fits("anything", "boolean") and key_ok(" a ") and not key_ok("  ") and not key_ok('a"')
    assert parse_record("1\tx", "nodes", "id:long\tage:long", "\t").rule == "value"  # age is an int whatever its type
    assert parse_record("x", "nodes", None, None).rule == "header"


def accepted(text, counts):
    cells = scan(text, ",")
    return cells is not None and len(cells) in counts


def brute(text, counts, most):
    """Fewest insertions and deletions of quotes and delimiters after which the grammar holds, None beyond ``most``."""
    level = {text}
    for cost in range(most + 1):
        if any(accepted(t, counts) for t in level):
            return cost
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t)) if t[i] in '",'} | {t[:i] + c + t[i:] for t in level for i in range(len(t) + 1) for c in '",'}
    return None


@example('"",""', {1})
@example('"\\","a', {1})
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='ab",\\\n', max_size=7), st.sets(st.integers(1, 4), min_size=1, max_size=2))
def test_cost_is_the_lowest(text, counts):
    counts = frozenset(counts)
    cost, edits = cheapest(text, ",", counts)
    assert cost == len(edits) and (cost == 0) == accepted(text, counts)
    least = brute(text, counts, 2)
    assert cost == least if least is not None else cost > 2


def test_very_long_record():
    p = parse_record('"' + "x" * 2_000_000 + "\ty\tz", "nodes", NODES, "\t")
    assert (p.rule, p.cost) == ("quoting", 1)
    assert parse_record("a\t" * 50_000, "nodes", NODES, "\t").rule == "count"


def test_memory_of_a_record_of_quotes():
    """A megabyte of quotes inside plain cells, each of which has to go; and many columns."""
    import tracemalloc

    tracemalloc.start()
    cost, edits = cheapest('a"' * 150_000 + ",b", ",", frozenset({2}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cost == len(edits) and cost <= 150_000 and peak < 90e6, peak
    cost, edits = cheapest(",".join(["a"] * 250), ",", frozenset({500}))
    assert (cost, set(edits)) == (250, {f"insert delimiter@{e.split('@')[1]}" for e in edits})


def test_records_without_quotes_are_judged_as_those_with(spark):
    """The expressions against the parse of one record."""
    import random

    rng = random.Random(5)
    heads = [("nodes", NODES, "\t"), ("nodes2", "name|age:long|score:double|w:float|k:LONG", "|"), ("rels", RELS, "\t"), ("rels", "a,b", ","), ("nodes", "age", "."), (None, "x:int,y", ","), ("nodes", None, ","), ("nodes", "x", "")]
    cells = ["1", "-7", "+0", "2147483648", "9223372036854775808", "00000000000000000000012", "1.5", "1e5", ".5", "x", "", " 1", "１", "a\x7f", "  ", "\ufffd", "é", "\r", '"q"', '"']
    files = spark.createDataFrame([(i, *h) for i, h in enumerate(heads)], "file_no int, series string, header string, delim string")
    rows = []
    for i in range(3000):
        k = rng.randrange(len(heads))
        n = len((heads[k][1] or "a").split(heads[k][2] or ",")) + rng.choice([0, 0, 0, 0, -1, 1])
        rows.append((i, k, i, (heads[k][2] or ",").join(rng.choice(cells) for _ in range(max(n, 1))) + rng.choice(["", "", "\r"])))
    got = {r.line_id: r for r in parse_records(spark.createDataFrame(rows, "line_id bigint, file_no int, line_no bigint, line string"), files).collect()}
    for i, k, _, line in rows:
        want = parse_record(line, *heads[k])
        assert (got[i].rule, got[i].cost, got[i].edits, got[i].cells) == (want.rule, want.cost, want.edits, want.cells), (heads[k], line)


def test_frames(spark):
    files = spark.createDataFrame([(1, "nodes", NODES, "\t", "clash"), (2, "rels", RELS.replace("\t", "|"), "|", "clash")], "file_no int, series string, header string, delim string, line string")
    lines = spark.createDataFrame(
        [(1, 1, 1, "A\t7\tx", "c"), (2, 1, 2, "A\tx", "c"), (3, 2, 1, "A|B|T||5", "c"), (3, 2, 1, "A|B|T||5", "c"), (4, 9, 1, "A", "c"), (5, 1, 3, None, "c"), (6, None, 1, "A", "c")],
        "line_id bigint, file_no int, line_no bigint, line string, header string",
    )
    got = sorted(((r.line_id, r.rule) for r in parse_records(lines, files).collect()), key=lambda x: x[0])
    assert got == [(1, None), (2, "value"), (3, None), (3, None), (4, "header"), (5, "null"), (6, "header")]
    assert {r.line_id for r in parse_records(lines, files, loaded=False).collect()} == {2, 4, 5, 6}
    cells = {r.line_id: r.cells for r in typed_cells(parse_records(lines, files, failed=False)).collect()}
    assert cells[1][1].whole == 7 and cells[3][4].whole == 5 and cells[3][3].text is None
    assert parse_records(lines.where("false"), files).count() == 0
    assert parse_records(lines, files.where("false"), loaded=False).count() == 7
