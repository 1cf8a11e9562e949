"""Every query with SQL against DuckDB on the smallest test data; every other query has to run there."""

import os

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes nodes2 rels raw_files raw_lines subjects subject_labels mix_targets".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return str(value) if isinstance(value, (list, dict, tuple)) else value


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    rel = duck.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(map(tuple, df.collect()), df.columns) == normal(rel.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql())))
def test_runs(spark, name):
    assert entry_point.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
