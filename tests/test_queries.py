import pytest
from compare import SF, assert_same

from tessera import operators
from tessera.plans import tpch

ALL = {**tpch.QUERIES, **operators.QUERIES}
SQL = {**tpch.QUERIES_SQL, **operators.SQL}


@pytest.mark.parametrize("name", sorted(ALL))
def test_same_rows_as_sql(spark, name):
    assert_same(ALL[name](spark, SF), SQL[name])


def test_every_query_has_sql():
    assert ALL.keys() == SQL.keys()
