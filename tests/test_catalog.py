import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Long fits; the check tool runs them.
SLOW = ("ml06", "ml07", "ml09", "ml12", "ml13", "mb23")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_sql_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith(SLOW)])
def test_query(spark, db, name):
    df = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert compare(df, db.sql(oracle_sql()[name])) == ""
    else:
        assert df.count() >= 0
