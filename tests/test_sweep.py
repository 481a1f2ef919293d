"""The sweep with failing dimensions, and the match indicator."""

import pytest
from pyspark.sql import functions as F

from apflow.plans import reconcile
from apflow.sources.fixtures import APTables
from oracles import params as P
from tests.conftest import SMALL


def _with_documents(spark, tables, one_in, text):
    bad = F.when(F.col("supplier_id") % one_in == 0, F.lit(text)).otherwise(F.col("custom_fields"))
    return APTables(spark, SMALL, tables={"supplier_information": tables.supplier_information.withColumn("custom_fields", bad)})


def _report(s):
    return {r.display_name: r for r in s.report.collect()}


def test_malformed_json_leaves_every_dimension(spark, tables):
    t = _with_documents(spark, tables, 50, "{not json")
    period = t.ledger_period(P.START, P.END)
    dims = reconcile.REFERENCE_DIMENSIONS
    s = reconcile.isolated_sweep(t, dims, P.START, P.END, period)
    assert {r.dim_id for r in s.table.select("dim_id").distinct().collect()} == set(range(16))
    report = _report(s)
    assert len(report) == 16 and {r.status for r in report.values()} == {"ok"}
    tier = report["Supplier: Tier (Custom)"]
    base = reconcile._coverage_base(t, P.START, P.END, period)
    expected = base.where("D_custom_fields = '{not json'").agg(F.sum(F.coalesce("_k", F.lit(1)))).first()[0]
    assert tier.invalid_count == expected > 0
    assert all(r.invalid_count == 0 for r in report.values() if r is not tier)
    # the lazy sweep reads the same text without failing, too
    lazy = reconcile.coverage_sweep(t, dims, P.START, P.END, period)
    assert sorted(map(str, lazy.collect())) == sorted(map(str, s.table.collect()))


def test_failing_dimensions_are_reported_and_the_others_are_whole(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    good = reconcile.REFERENCE_DIMENSIONS[:3]
    bad = [
        reconcile.Dimension("A", "nowhere", "missing"),
        reconcile.Dimension("B", "number", "cast", expr="CAST(B_number AS INT)"),
        reconcile.Dimension("A", "id", "zero", expr="A_id / (A_id - A_id)"),
        reconcile.Dimension("B", "name", "syntax", expr="upper(B_name"),
    ]
    dims = [bad[0], good[0], bad[1], good[1], bad[2], good[2], bad[3]]
    s = reconcile.isolated_sweep(tables, dims, P.START, P.END, period, amounts=True, sort_by="total_usd_k")
    report = _report(s)
    assert {n: (report[n].status, report[n].reason) for n in ("missing", "cast", "zero", "syntax")} == {
        "missing": ("skipped", "UNRESOLVED_COLUMN"), "cast": ("failed", "CAST_INVALID_INPUT"),
        "zero": ("failed", "DIVIDE_BY_ZERO"), "syntax": ("skipped", "PARSE_SYNTAX_ERROR")}
    assert report["cast"].value_count is None and report["cast"].invalid_count is None
    alone = reconcile.coverage_sweep(tables, good, P.START, P.END, period, amounts=True, sort_by="total_usd_k")
    strip = lambda df: sorted(str(r) for r in df.drop("dim_id").collect())
    assert strip(s.table) == strip(alone)
    assert {r.dim_id for r in s.table.select("dim_id").distinct().collect()} == {1, 3, 5}


def test_no_usable_dimension_and_errors_of_others(spark, tables):
    period = tables.ledger_period(P.START, P.END)
    none = [reconcile.Dimension("A", "nowhere", "missing")]
    with pytest.raises(ValueError, match="no usable dimension"):
        reconcile.isolated_sweep(tables, none, P.START, P.END, period)
    broken = period.withColumn("invoice__", F.raise_error(F.lit("the ledger is gone")).cast("string"))
    with pytest.raises(Exception, match="the ledger is gone"):
        reconcile.isolated_sweep(tables, reconcile.REFERENCE_DIMENSIONS[:2], P.START, P.END, broken)


def test_sweep_of_no_invoices(spark, tables):
    none = APTables(spark, SMALL, tables={"invoice_header": tables.invoice_header.limit(0)})
    s = reconcile.isolated_sweep(none, reconcile.REFERENCE_DIMENSIONS, P.START, P.END, none.ledger_period(P.START, P.END))
    assert s.table.count() == 0
    assert {(r.status, r.value_count, r.invalid_count) for r in s.report.collect()} == {("ok", 0, 0)}


def test_match_label_agrees_with_the_joined_pairs(spark, tables):
    ledger = tables.ledger_period(P.START, P.END)
    got = reconcile.with_match_label(tables.invoice_header, ledger, labels=("HERE", "LOST"))
    h = tables.invoice_header
    pairs = h.join(ledger, h.invoice_number == ledger.invoice__, "left").groupBy("id").agg(F.count("invoice__").alias("n"))
    assert {(r.id, r.match_label, r.ledger_rows) for r in got.collect()} == {
        (r.id, "HERE" if r.n else "LOST", r.n) for r in pairs.collect()}
