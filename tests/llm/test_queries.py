"""Registered queries against their oracles."""

import collections

import pytest

from tessera.llm import queries
from tests.oracle import connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_oracle(spark, name):
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = connect(SF).execute(queries.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert collections.Counter(tuple(r) for r in df.select(names).collect()) == collections.Counter(tuple(r[i] for i in at) for r in want.fetchall())
