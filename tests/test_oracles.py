"""Every query with an oracle, against DuckDB."""

import pytest

from inkframe.plans import gate_queries, raster_queries, shape_queries, stream_queries, table_oracles, table_queries

QUERIES = raster_queries.QUERIES | table_queries.QUERIES | gate_queries.QUERIES | shape_queries.QUERIES | stream_queries.QUERIES
ORACLE = raster_queries.ORACLE | table_oracles.ORACLE | gate_queries.ORACLE | shape_queries.ORACLE | stream_queries.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_oracle(spark, duck, data, same, name):
    same(QUERIES[name](spark, data), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_oracles_have_queries():
    assert set(ORACLE) <= set(QUERIES)
