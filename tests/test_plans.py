import pytest

from tests.oracle import compare
from tessera.plans import ORACLE_SQL, QUERIES

#: On the smallest tables some of the queries have no rows.
SF_DIR = "/root/testdata/sf0.01"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF_DIR, QUERIES[name], ORACLE_SQL[name]) > 0
