"""Every registered query against its SQL."""

import pytest

from checks.compare import compare, connect
from checks.oracle import SQL
from checks.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"consistency_native"}  # checked in test_evaluation


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, db, name):
    assert compare(QUERIES[name](spark, sf_dir), db, SQL[name]) == ""


def test_entry_has_rows(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    frame = entry(spark)
    assert frame.columns == ["schema_key", "table_key", "context_chars", "context_md5"]
    assert frame.count() > 0
    assert set(oracle_sql()) <= set(queries())
