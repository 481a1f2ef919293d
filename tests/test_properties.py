"""Invariants of the jobs."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from apflow.operators.invoices import LEDGER_GRAIN, dedupe_invoices, dedupe_ledger, valid_invoices
from apflow.plans import reconcile
from apflow.plans.payables import FactSpec, invoice_fact
from apflow.sources.fixtures import APTables
from oracles import params as P
from tests.conftest import SMALL


def test_bucket_triples_sum_to_total(spark, tables):
    f = invoice_fact(tables, FactSpec(P.START, P.END, since=P.RATES_SINCE, lookups=False))
    f = f.where(F.col("payment_date").isNotNull())
    bad = f.where(
        (F.col("amount_paid_on_net_due_date") + F.col("amount_paid_after_net_due_date")
         + F.col("amount_paid_before_net_due_date") != F.col("total_usd"))
        | (F.col("amount_paid_on_time") + F.col("amount_paid_late") + F.col("amount_paid_7_plus_days_early")
           != F.col("total_usd"))
    )
    assert f.count() > 0 and bad.count() == 0


def test_dedupe_is_idempotent(spark, tables):
    v = valid_invoices(tables.invoice_header, P.START, P.END, "loose")
    once = dedupe_invoices(v)
    twice = dedupe_invoices(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_ledger_repair_removes_exactly_the_duplicates(spark, tables):
    backup = tables.ledger_backup
    repaired = dedupe_ledger(backup)
    assert repaired.groupBy(*LEDGER_GRAIN).count().where("count > 1").count() == 0
    assert repaired.count() == backup.select(*LEDGER_GRAIN).distinct().count()
    # the control total drops by exactly the removed rows' amounts
    removed = backup.agg(F.sum("total_usd")).first()[0] - repaired.agg(F.sum("total_usd")).first()[0]
    extra = backup.groupBy(*LEDGER_GRAIN).agg(((F.count("*") - 1) * F.first("total_usd")).alias("x"))
    assert removed == extra.agg(F.sum("x")).first()[0]


def test_coverage_counts_add_up(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    out = reconcile.coverage_by(tables, E.SHIPPING_DIM, P.START, P.END, period, top_n=None)
    assert out.where(F.col("both_count") + F.col("source_only_count") != F.col("total_count")).count() == 0
    pct = out.select((F.col("both_pct") + F.col("source_only_pct")).alias("p")).collect()
    assert all(abs(r.p - 100.0) <= 0.011 for r in pct)


def test_fused_sweep_slice_equals_single_dimension(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    dim = reconcile.REFERENCE_DIMENSIONS[0]
    sweep = reconcile.coverage_sweep(tables, [dim], P.START, P.END, period, top_n=15, sort_by="total_count")
    single = reconcile.coverage_by(tables, dim, P.START, P.END, period, top_n=15, sort_by="total_count")
    single = single.withColumn("variable_value", F.col("variable_value").cast("string"))
    cols = sorted(single.columns)
    assert sorted(map(tuple, sweep.select(cols).collect())) == sorted(map(tuple, single.select(cols).collect()))


def test_match_counts_equal_naive_fan_out(spark, tables):
    """Weighted counts over pre-aggregated ledger matches == counting the fan-out join."""
    h = tables.invoice_header.select("invoice_number", "supplier_id")
    naive = h.join(tables.ledger, h.invoice_number == tables.ledger.invoice__, "left")
    naive = naive.groupBy("supplier_id").agg(
        F.count("*").alias("t"), F.count_if(F.col("invoice__").isNull()).alias("o")
    )
    fast = reconcile.with_match_count(h, tables.ledger).groupBy("supplier_id").agg(
        F.sum(F.coalesce("_k", F.lit(1))).alias("t"), F.sum(F.when(F.col("_k").isNull(), 1).otherwise(0)).alias("o")
    )
    assert naive.exceptAll(fast).count() == 0 and fast.exceptAll(naive).count() == 0


def test_results_do_not_depend_on_input_partitioning(spark):
    a, b = APTables(spark, SMALL), APTables(spark, SMALL)
    for t in (a, b):
        t._raw["orders"] = t.raw("orders").repartition(7 if t is a else 3)
    fa = reconcile.supplier_coverage(a.invoice_header, a.ledger, a.supplier_dim, P.START, P.END)
    fb = reconcile.supplier_coverage(b.invoice_header, b.ledger, b.supplier_dim, P.START, P.END)
    assert fa.exceptAll(fb).count() == 0 and fb.exceptAll(fa).count() == 0


def test_two_month_totals_differ_only_by_rows_without_supplier(spark, tables):
    """The basic and the supplier-filtered totals (J13) differ by exactly the NULL-supplier invoices."""
    basic = invoice_fact(tables, E._v1_spec(False, False))
    strict = invoice_fact(tables, E._v1_spec(True, False))
    diff = basic.agg(F.sum("total_usd")).first()[0] - strict.agg(F.sum("total_usd")).first()[0]
    no_supplier = basic.where(F.col("supplier_id").isNull()).agg(F.sum("total_usd")).first()[0] or 0
    assert diff == no_supplier


def test_reconciliation_partitions_every_invoice(spark, tables):
    m = reconcile.supplier_coverage(tables.invoice_header, tables.ledger, tables.supplier_dim, P.START, P.END)
    assert m.where(F.col("only_in_source") + F.col("present_in_both") != F.col("total_invoices")).count() == 0
    h = tables.invoice_header.where(F.col("payment_date").between(P.START, P.END))
    h = h.join(tables.supplier_dim.select(F.col("id").alias("_s")), F.col("supplier_id") == F.col("_s"))
    source_rows = h.count()
    only = m.agg(F.sum("only_in_source")).first()[0]
    unmatched = h.join(tables.ledger, h.invoice_number == tables.ledger.invoice__, "left_anti").count()
    assert only == unmatched and only <= source_rows


def test_exists_policy_counts_each_invoice_once(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    fan = reconcile.coverage_by(tables, E.SHIPPING_DIM, P.START, P.END, period, top_n=None)
    once = reconcile.coverage_by(tables, E.SHIPPING_DIM, P.START, P.END, period, top_n=None, match="exists")
    a = {r.variable_value: r for r in fan.collect()}
    b = {r.variable_value: r for r in once.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert b[k].source_only_count == a[k].source_only_count
        assert b[k].both_count <= a[k].both_count
    h = tables.invoice_header.where(F.col("payment_date").between(P.START, P.END))
    h = h.join(tables.supplier_dim.select(F.col("id").alias("_s")), F.col("supplier_id") == F.col("_s"))
    assert sum(r.total_count for r in b.values()) == h.count()


def test_sweep_skips_a_dimension_without_its_column(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    dims = [reconcile.Dimension("B", "no_such_column", "Broken"), reconcile.REFERENCE_DIMENSIONS[6]]
    out = reconcile.coverage_sweep(tables, dims, P.START, P.END, period, top_n=5)
    assert {r.display_name for r in out.select("display_name").distinct().collect()} == {"Invoice: Channel"}


def test_sort_keys_are_validated(spark, tables):
    import pytest

    period = tables.ledger_period(P.START, P.END)
    with pytest.raises(ValueError):
        reconcile.coverage_by(tables, E.SHIPPING_DIM, P.START, P.END, period, sort_by="total_count; DROP")
    with pytest.raises(ValueError):
        reconcile.coverage_sweep(tables, reconcile.REFERENCE_DIMENSIONS, P.START, P.END, period,
                                 sort_by="total_usd_k")  # amount column without amounts
