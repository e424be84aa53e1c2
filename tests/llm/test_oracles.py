"""Queries with SQL against DuckDB."""

import pytest

from inkframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_oracle(spark, duck, data, same, name):
    same(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name]))


def test_all_thirteen_are_there():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
