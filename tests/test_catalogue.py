import pytest
from oracle import same

from runlens.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name], ORACLE_SQL[name], spark)
