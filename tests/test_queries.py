"""Every registered query against its SQL in a second engine, on the smallest test tables."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from starqueries.queries import QUERIES  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
         " conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in NAMES:
        connection.execute(f"create view {name} as select * from read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def _sorted_rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(repr([_plain(row[i]) for i in order]) for row in data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF_DIR)
    found = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    answer = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert found == _sorted_rows(columns, answer.fetchall())


def test_every_query_is_registered():
    assert QUERIES.keys() <= entry.queries().keys() and QUERIES.keys() <= entry.oracle_sql().keys()


def test_other_queries_do_not_need_the_optional_ones(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert entry.queries().keys() == QUERIES.keys() == entry.oracle_sql().keys()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
