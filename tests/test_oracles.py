"""Every registered query with a SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from pairloom import plans
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES  # the corpus queries have tests of their own


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert difference(got, want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 6 and "rank_sum" in rows.columns
