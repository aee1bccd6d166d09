"""Every query of the subpackage that SQL can express, against its SQL."""

import pytest

from rillmark.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(same_as_sql, name):
    same_as_sql(registry.queries()[name], SQL[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
