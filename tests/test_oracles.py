import pytest

from tessera.plans import registry
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF).toPandas())
    want = rows(duck.execute(registry.oracle_sql()[name]).df())
    assert got == want
