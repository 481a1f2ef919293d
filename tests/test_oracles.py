"""Every registered query against its DuckDB oracle (row count, column names, values)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

NAMES = sorted(E._QUERIES)  # the jobs of the library itself


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(E._QUERIES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, SMALL, con)
    assert r["cols_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["exact"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["payment_month", "invoice_count", "amount_due_usd_millions", "wat_days", "wadtp_days"]
    assert df.count() > 0
