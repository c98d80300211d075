"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tests.oracle import check, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


def test_entry(spark):
    df = entry.entry(spark)
    assert "column" in df.columns
    assert df.count() == 11


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert check(df, df.collect(), duck, ORACLES[name]) == "ok"


@pytest.mark.parametrize("name", ["scatter_sample", "forecast_arima", "throttle_users", "score_orders", "workspace_context"])
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
