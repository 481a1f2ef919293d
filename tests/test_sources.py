"""Caller-supplied warehouse tables and SQL views."""

import os
import tempfile

import pytest

import __spark_entry__ as E
from apflow.plans import payables
from apflow.plans.payables import FactSpec
from apflow.sources.fixtures import AP_TABLE_NAMES, APTables
from oracles import params as P


def test_jobs_run_on_caller_tables(spark, tables):
    """Write the AP tables out as a warehouse would hold them, then run a job on those tables only."""
    root = tempfile.mkdtemp(prefix="apflow-wh-")
    needed = ["invoice_header", "exchange_rate"]
    given = {}
    for n in needed:
        getattr(tables, n).write.parquet(os.path.join(root, n))
        given[n] = spark.read.parquet(os.path.join(root, n))
    own = APTables(spark, None, tables=given)
    spec = FactSpec(P.START, P.END, since=P.RATES_SINCE, excluded_currency=P.EXCLUDED_CURRENCY, lookups=False)
    a = payables.monthly_trend(payables.invoice_fact(own, spec))
    b = payables.monthly_trend(payables.invoice_fact(tables, spec))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        own.supplier_dim  # noqa: B018  (no testdata folder, not given)


def test_unknown_table_name_is_rejected(spark):
    with pytest.raises(ValueError):
        APTables(spark, None, tables={"invoices": spark.range(1)})


def test_register_views(spark, tables):
    names = tables.register_views(prefix="ap_")
    assert len(names) == len(AP_TABLE_NAMES)
    n = spark.sql("SELECT COUNT(*) AS n FROM ap_invoice_header WHERE status != 'Voided'").first().n
    assert n == tables.invoice_header.where("status != 'Voided'").count()
    assert E.queries()  # the registry still builds


def test_from_catalog_reads_named_tables(spark, tables):
    tables.invoice_header.write.mode("overwrite").saveAsTable("ap_header_copy")
    own = APTables.from_catalog(spark, {"invoice_header": "default.ap_header_copy"})
    assert own.invoice_header.count() == tables.invoice_header.count()
