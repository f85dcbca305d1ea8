import pytest
from lantern.queries import ORACLES, QUERIES, flagship
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


def test_flagship(spark):
    found = flagship(spark, SF).collect()
    assert found and all(r.copies > 1 for r in found)
