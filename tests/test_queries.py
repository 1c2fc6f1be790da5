"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.compare import compare, connect
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.take(1)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4


def test_same_result_when_every_group_is_split(spark, con, group_limit):
    group_limit(150)
    for name in ("canary_run", "latency_report", "progress_curve", "counter_increase", "rolling_health", "token_bucket", "attach_health"):
        assert compare(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None, name
