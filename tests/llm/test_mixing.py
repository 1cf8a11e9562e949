import random

import pytest

from weftgraph.llm import mixing

SIZES = "doc_id bigint, source string, n_tokens bigint, weight double, draw int"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, sizes, targets, **kw):
    s = spark.createDataFrame([(i, a, b, 1.0, 2) for i, (a, b) in enumerate(sizes)], SIZES)
    t = spark.createDataFrame(targets, TARGETS)
    m = mixing.mix(s, t, **kw)
    return [tuple(r) for r in m.collect()], {r.source: r for r in mixing.shares(m, t).collect()}


def test_spent_at():
    assert mixing.spent_at({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, 50) == 50
    assert mixing.spent_at({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}, 60) == 100  # a ends at 20 with 10 of it, b gives the other 50
    assert mixing.spent_at({"a": 10, "b": 10}, {"a": 0.5, "b": 0.5}, 1000) == 20


def test_shares_repeats_and_order(spark):
    rng = random.Random(1)
    sizes = [("big", rng.randrange(1, 50)) for _ in range(3000)] + [("small", rng.randrange(1, 50)) for _ in range(300)] + [("tiny", 20)] * 10 + [("other", 9)] * 50 + [(None, 9)] * 5 + [("big", 0)] * 5
    targets = [("big", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.05, 3), ("absent", 0.05, 9), ("off", 0.0, 3)]
    rows, shares = run(spark, sizes, targets)
    budget = sum(n for s, n in sizes if s in ("big", "small", "tiny"))
    total = sum(r[3] for r in rows)
    assert budget - 3 * 50 < total <= budget
    assert [r[4] for r in rows] == sorted(r[4] for r in rows)
    assert abs(shares["big"].share / shares["small"].share - 2) < 0.05
    assert shares["tiny"].tokens == 3 * 200 and shares["tiny"].most_copies == 3  # runs out: as far as max_repeats allows
    assert (shares["absent"].tokens, shares["absent"].share, shares["off"].share) == (0, 0.0, 0.0) and set(shares) == {"big", "small", "tiny", "absent", "off"}
    assert len({(r[0], r[2]) for r in rows}) == len(rows) and {r[1] for r in rows} == {"big", "small", "tiny"}
    half = [r for r in rows if r[4] <= rows[-1][4] / 2]
    assert abs(sum(r[3] for r in half if r[1] == "small") / sum(r[3] for r in half if r[1] == "big") - 0.5) < 0.08  # shares hold all along


def test_finish_times_are_exact_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 10)
    rows, _ = run(spark, [("a", i % 7 + 1) for i in range(500)], [("a", 1.0, 2)], budget=10**9)
    assert len(rows) == 1000
    used = 0
    for r in rows:
        used += r[3]
        assert r[4] == used  # one source of weight 1: the finish time is the running sum
    assert [r[2] for r in rows] == [1] * 500 + [2] * 500


def test_edges(spark):
    assert run(spark, [("a", 5)], [("b", 1.0, 1)])[0] == []
    assert run(spark, [], [("b", 1.0, 1)])[1]["b"].tokens == 0
    assert len(run(spark, [("a", 5)] * 4, [("a", 1.0, 3)], budget=11)[0]) == 2
    with pytest.raises(ValueError, match="twice"):
        run(spark, [("a", 5)], [("a", 0.5, 1), ("a", 0.5, 1)])


def test_sized(spark):
    docs = spark.createDataFrame([(1, "Hello", "a", 1), (2, None, "a", 1), (3, "x", None, 1), (4, "x", "z", 1)], "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 1.0, 2), ("a2", 0.0, 1)], TARGETS)
    assert sorted(map(tuple, mixing.sized(docs, targets).collect())) == [(1, "a", 1), (2, "a", 0)]
