"""Every registered query of the engine that SQL can express, against its SQL."""

import pytest

from rillmark.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(same_as_sql, name):
    same_as_sql(catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").limit(3).count() > 0
