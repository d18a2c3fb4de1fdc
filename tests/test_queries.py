"""Every point-cloud query against its SQL; those without SQL run and keep their schema."""

import pytest
from oracle import spark_rows, sql_rows

from geolode.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(spark, sf_dir, name):
    first = QUERIES[name](spark, sf_dir)
    rows = first.collect()
    assert rows and first.schema == QUERIES[name](spark, sf_dir).schema
    if name not in ("smp_random",):
        assert sorted(map(repr, rows)) == sorted(map(repr, QUERIES[name](spark, sf_dir).collect()))
