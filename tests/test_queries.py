"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest
from compare import difference, duck
from kgspark.plans.files import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
