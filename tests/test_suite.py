"""Every registered query with SQL gives the same rows as that SQL, here on the smallest tables."""

import duckdb
import pytest
from check_queries import TABLES, compare

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, connection, name):
    outcome = compare(spark, connection, name, FOLDER)
    assert outcome.startswith("ok"), outcome
    assert "types differ" not in outcome, outcome


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
