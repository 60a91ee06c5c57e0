"""Every query with SQL gives the rows that DuckDB gives."""

import pytest

from reconloom.plans.registry import QUERIES, oracles

ORACLES = oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(same_rows, name):
    same_rows(QUERIES[name], ORACLES[name])
