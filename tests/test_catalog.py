"""Every registered query against its SQL on the small test tables."""

import os

import pytest
from compare import connect, differences

from trackloom.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert not differences(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["car_id", "avg_speed"]
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
