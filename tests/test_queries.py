"""Every query of the library against its SQL on the smallest tables."""

import pytest

from foliospark import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
