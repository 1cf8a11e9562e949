"""Corpus queries over empty and over dirty tables."""

import os

import pytest

from tests.dirty import DATA, write
from weftgraph.llm.queries import QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = write(spark, f"{tmp_path_factory.getbasetemp()}/empty", "empty")
    assert QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_repeats_and_surplus_columns(spark, tmp_path_factory, name):
    folder = write(spark, f"{tmp_path_factory.getbasetemp()}/dirty", "dirty")
    got = QUERIES[name](spark, folder)
    rows = got.collect()
    if name == "p6_ids":
        assert len(rows) == 2 * spark.read.parquet(f"{DATA}/documents.parquet").count() + 2
        assert all(r.ids == [] for r in rows if r.doc_id is None)
    if name == "p7_mix":
        assert {r.source for r in rows} <= {r.source for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
