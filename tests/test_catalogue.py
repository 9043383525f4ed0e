import pytest

from sievework.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, sf_dir, oracle, rows_of, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == oracle(catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
