import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftgraph.operators.references import orphan_report, orphans
from weftgraph.operators.skew import dominant_keys, salted_stats

NODE = "row_id bigint, `name:string:users` string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, h int, t string"
REL = "row_id bigint, c0 string, c1 string, loaded_at timestamp_ntz, side int, x string"
T0 = datetime(2025, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def frames(spark, nodes, rels):
    n = spark.createDataFrame([(i, a, at(b), at(c), 1, "x") for i, (a, b, c) in enumerate(nodes)], NODE)
    r = spark.createDataFrame([(i, a, b, at(c), 1, "x") for i, (a, b, c) in enumerate(rels)], REL)
    return r, n


def brute(nodes, rels):
    bad = lambda v: v is None or not v.strip(" ") or any(ord(c) < 32 or c in "\x7f�" for c in v) or v.count('"') % 2
    out = []
    for i, (a, b, t) in enumerate(rels):
        for side, v in (("c0", a), ("c1", b)):
            if not bad(v) and not (t is not None and any(n == v and s is not None and s <= t and (e is None or e > t) for n, s, e in nodes)):
                out.append((i, side))
    return sorted(out)


def found(spark, nodes, rels, per=1_000_000):
    r, n = frames(spark, nodes, rels)
    return sorted((x.row_id, x.side) for x in orphans(r, [n, n.where("false")], rows_per_range=per).collect())


def test_edges(spark):
    nodes = [("A", 1, 5), ("A", 4, 6), ("A", 8, None), ("B", 0, 0), ("C", None, None), (None, 0, None), ("D", 2, None), ("D", 2, None)]
    rels = [("A", "A", t) for t in (0, 1, 5, 6, 7, 8)] + [("B", "C", 3), ("", None, 3), (" ", 'x"', 3), ("D", "d", 2), ("D", "D ", None), ("E", "E", 3), ("E", "E", 3), ("a\tb", "a�", 3)]
    assert found(spark, nodes, rels) == brute(nodes, rels)


@pytest.mark.parametrize("hot", [False, True])
def test_random_over_many_ranges(spark, hot):
    rng = random.Random(5)
    name = lambda: "H" if hot and rng.random() < 0.4 else f"n{rng.randrange(60)}"
    nodes = [(name(), s := rng.randrange(100), rng.choice([None, s + rng.randrange(30), s + 2])) for _ in range(200)]
    rels = [(name(), name(), rng.randrange(120)) for _ in range(1500)]
    # 60 rows a range: a hot name lies in many ranges, its standing parents often in an earlier one
    assert found(spark, nodes, rels, 60) == brute(nodes, rels)


def test_same_key_and_time_everywhere(spark):
    assert found(spark, [("H", 0, None)], [("H", "X", 1)] * 2000, 100) == [(i, "c1") for i in range(2000)]


def test_empty_tables_and_report(spark):
    r, n = frames(spark, [("A", 0, None)], [("A", "B", 1), ("B", "A", 800), ("A", "A", None)])
    assert orphans(r.where("false"), [n]).count() == 0
    assert orphans(r, [n.where("false")]).count() == 6
    rows = {(x.side, x.month): (x.n_refs, x.n_orphans) for x in orphan_report(r, orphans(r, [n])).collect()}
    assert rows == {("c0", "2025-01"): (1, 0), ("c0", "2025-02"): (1, 1), ("c1", "2025-01"): (1, 1), ("c1", "2025-02"): (1, 0), ("c0", None): (1, 1), ("c1", None): (1, 1)}


def test_salted_stats(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["H"] * 6 + ["a", "b", None, ""]), f"v{rng.randrange(40)}" if rng.random() > 0.1 else None, rng.choice(["T", "U"]), rng.randrange(1, 11)) for _ in range(3000)]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "c0 string, c1 string, c2 string, load_no int, value int, salt string")
    stats = salted_stats(table, ["c0", "c2"], "c1", "load_no", sample_rows=500)
    want = {}
    for c0, c1, c2, n in rows:
        for f, k in (("c0", c0), ("c2", c2)):
            if k:
                w = want.setdefault((f, k), [0, 99, 0, set()])
                w[0], w[1], w[2] = w[0] + 1, min(w[1], n), max(w[2], n)
                w[3] |= {c1} - {None}
    got = {(r.field_name, r.key_value): [r.n_rows, r.first_load, r.last_load, r.end_names] for r in stats.collect()}
    assert got == {k: [a, b, c, len(d)] for k, (a, b, c, d) in want.items()}
    top = {(r.field_name, r.key_value) for r in dominant_keys(stats, len(rows)).collect()}
    assert top == {k for k, w in want.items() if w[0] >= 0.02 * len(rows)}
    plain = salted_stats(table, ["c0", "c2"], "c1", "load_no", distinct=False)
    assert {(r.field_name, r.key_value): r.n_rows for r in plain.collect()} == {k: w[0] for k, w in want.items()}
    assert salted_stats(table.where("false"), ["c0"], "c1", "load_no").count() == 0
    null = table.select("c0", F.lit(None).cast("string").alias("c1"), "c2", "load_no")
    assert {r.end_names for r in salted_stats(null, ["c2"], "c1", "load_no").collect()} == {0}
