"""Problem queries over empty and over dirty tables."""

import os

import pytest

from tests.dirty import DATA, write
from weftgraph.plans.problems import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = write(spark, f"{tmp_path_factory.getbasetemp()}/empty", "empty")
    assert QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_surplus_columns(spark, tmp_path_factory, name):
    folder = write(spark, f"{tmp_path_factory.getbasetemp()}/dirty", "dirty")
    got, clean = QUERIES[name](spark, folder), QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == clean.columns
    before = [tuple(r) for r in clean.collect()]
    if name in ("p1_found", "p2_found"):  # every failing row twice, and those of the null rows
        assert sorted(r for r in rows if None not in r) == sorted(before * 2)
    if name in ("p3_found", "p5_found"):
        assert sorted(rows) == sorted(before)
