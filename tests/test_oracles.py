"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle import difference, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert difference(df.columns, rows, columns, result.fetchall()) is None


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
