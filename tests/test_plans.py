"""Plan-shape guards: no query may pair rows blindly or gather a whole table into one task."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

NAMES = sorted(E._QUERIES)  # the jobs of the library itself


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cartesian_or_single_partition_window(spark, name):
    plan = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name
    # a Window with an empty partition spec gathers every row into one partition
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            assert not re.search(r"\], \[\], \[", line), (name, line)


@pytest.mark.parametrize("name", ["j05_dedupe_invoices", "j26_keep_one_ledger", "j36_top_n_values",
                                  "j33_coverage_sweep"])
def test_top_per_group_is_limited_before_the_shuffle(spark, name):
    df = E.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_ledger_match_counts_need_no_sort(spark):
    """With only grain columns used, the ledger repair is planned as a hash distinct."""
    plan = _plan(E.queries()["j20_supplier_coverage"](spark, SMALL))
    assert "min_by" not in plan and "Window" not in plan


def test_rate_totals_join_without_shuffling_the_lines_by_currency(spark):
    for name in ("j04_to_usd", "j18_naive_line_rate_total", "j19_weighted_average_terms"):
        for line in _plan(E.queries()[name](spark, SMALL)).splitlines():
            assert not ("Exchange hashpartitioning(currency_id" in line), (name, line)
