import pytest

from reconloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(same_rows, name):
    same_rows(QUERIES[name], ORACLES[name])
