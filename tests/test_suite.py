"""Every query of the suite against its oracle, at a scale where each finds something."""

import os

import duckdb
import pytest
from comparison import duck_rows, rows_of

from quern import suite

SF = os.environ.get("TEST_SUITE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in sorted(os.listdir(SF)):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query_matches_oracle(spark, tables, name):
    got = rows_of(suite.QUERIES[name](spark, SF))
    assert got[1] and got == duck_rows(tables, suite.ORACLES[name])


def test_every_query_has_an_oracle():
    assert suite.QUERIES.keys() == suite.ORACLES.keys()
