"""Each query against its SQL, on whole tables."""

import pytest

from sievework.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, oracle, rows_of, name):
    assert rows_of(queries.QUERIES[name](spark, sf_dir)) == oracle(queries.SQL[name])
