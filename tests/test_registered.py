"""All registered queries of the library next to DuckDB."""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from codeskein.plans.suite import SUITE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(name for name, item in SUITE.items() if item.oracle)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    assert differences(spark, duck, FOLDER, SUITE[name].run, SUITE[name].oracle) == []


def test_entry(spark):
    assert entry.entry(spark).count() == 10
