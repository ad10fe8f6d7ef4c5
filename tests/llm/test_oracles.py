"""Queries with a DuckDB twin give its rows."""

import pytest
from compare import connect, differences

from codeskein.llm.op_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, folder, name):
    assert differences(spark, connect(folder), folder, QUERIES[name], ORACLES[name]) == []
