from __future__ import annotations

import pytest
from oracle import database, same

from textquarry import registry


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, small, con, name):
    same(registry.QUERIES[name](spark, small), con, registry.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
