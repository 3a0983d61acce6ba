import pytest
from comparing import same

from trailmark.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, sf_dir, duck, name):
    got, want = same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_oracle_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
