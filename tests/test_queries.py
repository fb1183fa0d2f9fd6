"""Every registered query against its SQL counterpart, on whole tables."""

import pytest

import __spark_entry__ as driver
from compare import connect, differences
from scoreloom.plans.oracle import ORACLES
from scoreloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def other(small):
    con = connect(small)
    yield con
    con.close()


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, other, name):
    result = QUERIES[name](spark, small)
    assert differences(result, other, ORACLES[name]) == []


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["prompt_id", "n_rows", "mean_reward", "best_reward", "best_id"]
    assert result.count() == 50
