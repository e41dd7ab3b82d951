"""Every registered query against its oracle, on the smallest tables."""

import pytest
from conftest import SF

from check_oracles import compare, connect
from corpuscat.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["split", "label", "n"] and df.count() > 0
