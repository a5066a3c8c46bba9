from __future__ import annotations

import duckdb
import pytest
from oracle import same
from sample_queries import MAKE, ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_operators_over_sample_trees(spark, name):
    same(MAKE[name](spark), duckdb.connect(), ORACLES[name])
