"""Every query with SQL gives the same rows in both engines; the others give some."""

from pathlib import Path

import pytest

from clauseloom.catalog import ORACLES, QUERIES
from tests.oracle import compare

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, DATA, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert not QUERIES[name](spark, DATA).isEmpty()


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
