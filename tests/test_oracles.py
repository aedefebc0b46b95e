"""Every registered query against its checking SQL on the smallest folder."""

import os

import pytest

import __spark_entry__ as entry_module
from ledgerloom.plans import registry
from oracle_harness import cell, connect, rows_of

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_check_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
    # The optional corpus operators have their own brute-force tests; of the others three have no SQL.
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) - len(registry.ORACLES) <= 3


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_cells_compare_numbers_by_value():
    assert cell(1) == cell(1.0) != cell(1.5)


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
