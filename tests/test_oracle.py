"""Every registered query of the library against its SQL on the smallest tables."""

import pytest
from causeway import catalog
from conftest import same_rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE[name])
    spark.catalog.clearCache()


def test_all_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
