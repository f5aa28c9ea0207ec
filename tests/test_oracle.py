"""Every registered query against its SQL on the small tables."""

import oracle
import pytest

from wardline.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    difference = oracle.compare(QUERIES[name](spark, sf_dir), con, SQL[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["lang", "stage", "is_safe", "documents"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
