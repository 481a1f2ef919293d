"""

``queries()[name](spark, sf_dir)`` builds the Spark plan of one job over the
AP tables derived from ``sf_dir``; ``oracle_sql()[name]`` is the same job as
DuckDB SQL over the testdata views. Parameters are shared (``oracles.params``)
and every window spans the whole testdata range.
"""

from __future__ import annotations

import logging
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from apflow.operators import invoices as inv_ops  # noqa: E402
from apflow.operators import lookups, profile, rates  # noqa: E402
from apflow.plans import ledger, payables, reconcile, reports  # noqa: E402
from apflow.plans.payables import FactSpec  # noqa: E402
from apflow.sources.fixtures import APTables, fixture_region_map  # noqa: E402
from apflow.session import ensure_checkpoint_dir  # noqa: E402
from oracles import jobs as O  # noqa: E402
from oracles import params as P  # noqa: E402

log = logging.getLogger(__name__)

SMOKE_DIR = "/root/testdata/sf0.001"


_TABLES: dict[tuple[int, str], APTables] = {}


def _t(spark: SparkSession, sf_dir: str) -> APTables:
    """The AP tables of ``sf_dir``; plans (not data) are reused within one live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = (id(spark), sf_dir)
    cached = _TABLES.get(key)
    alive = (
        cached is not None
        and cached.spark is spark
        and spark.sparkContext._jsc is not None
        and cached.spark.sparkContext is spark.sparkContext
    )
    if not alive:
        _TABLES[key] = APTables(spark, sf_dir)
    return _TABLES[key]


def _problem(t: APTables) -> DataFrame:
    metrics = reconcile.supplier_coverage(t.invoice_header, t.ledger, t.supplier_dim, P.START, P.END)
    return reconcile.problem_suppliers(metrics, P.MIN_PCT_MISSING, P.TOP_PROBLEM_SUPPLIERS, written=t.written)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly payables trend with the computed supplier exclusion."""
    t = _t(spark, sf_dir)
    spec = FactSpec(
        P.START, P.END, rules="loose", rates="monthly", base=P.BASE_CURRENCY, since=P.RATES_SINCE,
        excluded_currency=P.EXCLUDED_CURRENCY, excluded_suppliers=_problem(t), lookups=False,
    )
    return payables.monthly_trend(payables.invoice_fact(t, spec))


def entry(spark: SparkSession) -> DataFrame:
    return flagship(spark, SMOKE_DIR)


# --------------------------------------------------------------------- jobs
def _v3_spec(t: APTables, lookups: bool, excluded) -> FactSpec:
    return FactSpec(
        P.START, P.END, rules="loose", rates="monthly", base=P.BASE_CURRENCY, since=P.RATES_SINCE,
        excluded_currency=P.EXCLUDED_CURRENCY, excluded_suppliers=excluded, lookups=lookups,
        variant="v3", region_map=fixture_region_map(),
    )


def _v1_spec(require_supplier: bool, lookups: bool) -> FactSpec:
    return FactSpec(
        P.START, P.END, rules="strict", rates="window", base=P.BASE_CURRENCY,
        excluded_currency=P.EXCLUDED_CURRENCY, require_supplier=require_supplier, lookups=lookups,
        variant="basic", region_map=fixture_region_map(),
    )


def j01(spark, d):
    return rates.latest_rate_in_window(_t(spark, d).exchange_rate, P.BASE_CURRENCY, P.START, P.END)


def j02(spark, d):
    return rates.monthly_rates(_t(spark, d).exchange_rate, P.BASE_CURRENCY, P.RATES_SINCE)


def j03(spark, d):
    return rates.monthly_rates_by_rate_date(_t(spark, d).exchange_rate)


def j04(spark, d):
    t = _t(spark, d)
    m = rates.monthly_rates(t.exchange_rate, P.BASE_CURRENCY, P.RATES_SINCE)
    h = t.invoice_header.select("id", "currency_id", "payment_date", "gross_total")
    return rates.to_usd(h, m, by_month_of="payment_date")


def j04_window(spark, d):
    t = _t(spark, d)
    r = rates.latest_rate_in_window(t.exchange_rate, P.BASE_CURRENCY, P.START, P.END)
    h = t.invoice_header.select("id", "currency_id", "payment_date", "gross_total")
    return rates.to_usd(h, r, by_month_of=None, direction="multiply", missing_rate="null")


def j05(spark, d):
    t = _t(spark, d)
    v = inv_ops.valid_invoices(t.invoice_header, P.START, P.END, "loose", excluded_currency=P.EXCLUDED_CURRENCY)
    return inv_ops.dedupe_invoices(v).select("id", "invoice_number", "gross_total", "payment_date", "supplier_id")


def j06(spark, d):
    t = _t(spark, d)
    v = inv_ops.valid_invoices(t.invoice_header, P.START, P.END, "strict", excluded_currency=P.EXCLUDED_CURRENCY)
    return v.select("id", "invoice_number", "payment_date", "gross_total", "currency_id")


def j07(spark, d):
    t = _t(spark, d)
    v = inv_ops.valid_invoices(t.invoice_header, P.START, P.END, "strict_no_currency")
    return inv_ops.dedupe_with_line_currency(v, t.invoice_line)


def j08(spark, d):
    t = _t(spark, d)
    v = inv_ops.valid_invoices(t.invoice_header, P.START, P.END, "strict", excluded_currency=P.EXCLUDED_CURRENCY)
    return inv_ops.filter_supplier(inv_ops.dedupe_invoices(v)).select("id", "invoice_number", "supplier_id")


def j09(spark, d):
    return payables.month_total_line_currency(_t(spark, d), P.START, P.END, P.BASE_CURRENCY)


def j10(spark, d):
    return payables.daily_totals(_t(spark, d), P.START, P.END, P.BASE_CURRENCY, P.EXCLUDED_CURRENCY)


def j11(spark, d):
    return payables.invoice_fact(_t(spark, d), _v1_spec(False, True))


def j11_all_lookups(spark, d):
    spec = FactSpec(
        P.START, P.END, rules="strict", rates="window", base=P.BASE_CURRENCY, excluded_currency=P.EXCLUDED_CURRENCY,
        require_supplier=True, lookups=True, variant="v3", region_map=fixture_region_map(),
    )
    return payables.invoice_fact(_t(spark, d), spec)


def j12(spark, d):
    t = _t(spark, d)
    return payables.invoice_fact(t, _v3_spec(t, True, _problem(t)))


def j13(spark, d):
    return payables.total_millions(payables.invoice_fact(_t(spark, d), _v1_spec(True, False)))


def j13_basic(spark, d):
    return payables.total_millions(payables.invoice_fact(_t(spark, d), _v1_spec(False, False)))


def j14(spark, d):
    t = _t(spark, d)
    return payables.monthly_trend(payables.invoice_fact(t, _v3_spec(t, False, P.EXCLUDED_SUPPLIERS)))


def j15(spark, d):
    return flagship(spark, d)


def j15_full_lookups(spark, d):
    t = _t(spark, d)
    return payables.monthly_trend(payables.invoice_fact(t, _v3_spec(t, True, _problem(t))))


def j16(spark, d):
    t = _t(spark, d)
    return lookups.po_numbers(t.invoice_line, t.order_line, t.order_header)


def j17(spark, d):
    t = _t(spark, d)
    return lookups.supplier_country(t.supplier_address, t.country)


def j18(spark, d):
    return payables.naive_line_rate_total(_t(spark, d), P.PAID_AFTER, P.BASE_CURRENCY)


def j19(spark, d):
    return payables.weighted_average_terms(_t(spark, d))


def j20(spark, d):
    t = _t(spark, d)
    return reconcile.supplier_coverage(t.invoice_header, t.ledger, t.supplier_dim, P.START, P.END)


def j21(spark, d):
    return _problem(_t(spark, d))


def j22(spark, d):
    return reconcile.missing_invoices(_t(spark, d), P.START, P.END)


def j23(spark, d):
    return inv_ops.dedupe_ledger(_t(spark, d).ledger_backup)


def j23_control_totals(spark, d):
    t = _t(spark, d)
    return inv_ops.repair_control_totals(t.ledger_backup, t.ledger)


def j23_repaired_copy(spark, d):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/apflow-tables/ledger-{uuid.uuid4().hex}"
    ledger.repair_ledger(_t(spark, d).ledger_backup, path, to_path=True)
    return spark.read.parquet(path)


def j24(spark, d):
    return inv_ops.duplicate_audit(_t(spark, d).ledger_backup, ("invoice__", "supplier"), P.LEDGER_AFTER)


def j25(spark, d):
    return inv_ops.duplicate_audit(
        _t(spark, d).ledger_backup, ("invoice__", "supplier", "total_usd"), P.LEDGER_AFTER
    )


def j26(spark, d):
    return inv_ops.keep_one_ledger(_t(spark, d).ledger, P.LEDGER_AFTER)


def j27(spark, d):
    return reconcile.side_by_side(_t(spark, d), P.START, P.END, P.RATES_SINCE, P.LEDGER_AFTER, P.BASE_CURRENCY)


def j28(spark, d):
    return reconcile.missing_rate_by_creator(_t(spark, d), P.START, P.END, P.MIN_INVOICES)


def j29(spark, d):
    return reconcile.missing_rate_by_supplier(_t(spark, d), P.START, P.END, P.MIN_INVOICES)


def _period(t: APTables) -> DataFrame:
    return t.ledger_period(P.START, P.END)


def j30(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_by_tier(t, P.START, P.END, _period(t))


def j30_subset(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_by_tier(t, P.START, P.END, _period(t), suppliers_in=P.TIER_SUBSET)


NAME_DIM = reconcile.Dimension("B", "name", "Supplier: Supplier Name")
SHIPPING_DIM = reconcile.Dimension("B", "shipping_term_id", "Supplier: Shipping Term")
CURRENCY_DIM = reconcile.Dimension("A", "currency_id", "Currency")


def j31(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_by(t, NAME_DIM, P.START, P.END, _period(t), top_n=15)


def j31_shipping_term(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_by(t, SHIPPING_DIM, P.START, P.END, _period(t), top_n=None,
                                 sort_by="total_count", with_supplier_info=False)


def j32(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_by(t, CURRENCY_DIM, P.START, P.END, _period(t), top_n=20,
                                 sort_by="source_only_total_usd_k", amounts=True, rates_since=P.RATES_SINCE)


def j33(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_sweep(t, reconcile.REFERENCE_DIMENSIONS, P.START, P.END, _period(t),
                                    top_n=15, sort_by="total_count")


def j33_amounts(spark, d):
    t = _t(spark, d)
    return reconcile.coverage_sweep(t, reconcile.REFERENCE_DIMENSIONS, P.START, P.END, _period(t), top_n=20,
                                    sort_by="source_only_total_usd_k", amounts=True, rates_since=P.RATES_SINCE)


# three dimensions that cannot work: a missing column, an unfinished expression, a cast that rows fail
FAILING_DIMENSIONS = [
    (reconcile.Dimension("A", "cost_center", "Invoice: Cost Center"), "skipped", "UNRESOLVED_COLUMN"),
    (reconcile.Dimension("B", "name", "Supplier: Name Prefix", expr="left(B_name,"), "skipped", "PARSE_SYNTAX_ERROR"),
    (reconcile.Dimension("B", "number", "Supplier: Number as Integer", expr="CAST(B_number AS INT)"), "failed", "CAST_INVALID_INPUT"),
]


def _isolated(spark, d) -> reconcile.Sweep:
    t = _t(spark, d)
    cut_off = F.when(F.col("supplier_id") % P.DAMAGED_EVERY == 0, F.lit(P.DAMAGED_JSON)).otherwise(F.col("custom_fields"))
    damaged = APTables(spark, d, tables={
        "supplier_information": t.supplier_information.withColumn("custom_fields", cut_off)})
    dims = reconcile.REFERENCE_DIMENSIONS + [f[0] for f in FAILING_DIMENSIONS]
    return reconcile.isolated_sweep(damaged, dims, P.START, P.END, _period(damaged), top_n=15, sort_by="total_count")


def j33_isolated(spark, d):
    return _isolated(spark, d).table


def j33_report(spark, d):
    return _isolated(spark, d).report


def j31_match_labels(spark, d):
    t = _t(spark, d)
    return reconcile.match_labels(t, P.START, P.END, _period(t))


def _lineitem(spark, d):
    return _t(spark, d).raw("lineitem").select(*P.PROFILE_COLUMNS)


def j34(spark, d):
    return profile.data_snapshot(_lineitem(spark, d))


def j35(spark, d):
    return profile.unique_values(_lineitem(spark, d), P.PROFILE_COLUMNS)


def _edge_values(spark, d):
    """Line items with NULLs, NaN, an infinity, integers and decimals beyond a double, days and truth values."""
    li = _t(spark, d).raw("lineitem")
    k = F.col("l_orderkey")
    return li.select(
        F.when(k % 5 != 0, F.col("l_quantity")).alias("quantity_or_null"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("tax_or_nan"),
        F.when((k == 1) & (F.col("l_linenumber") == 1), F.lit(float("-inf"))).otherwise(F.col("l_discount")).alias("discount_or_infinite"),
        (F.lit(2**53) + k % 64).alias("beyond_double"),
        (F.lit("12345678901234567890").cast("decimal(38,2)") + F.col("l_linenumber").cast("decimal(10,2)") / 100).cast("decimal(38,2)").alias("wide_decimal"),
        (F.col("l_linenumber").cast("decimal(10,2)") - 4).cast("decimal(10,2)").alias("signed_decimal"),
        F.to_date("l_shipdate").alias("day"), (k % 3 == 0).alias("flag"), F.lit(None).cast("string").alias("nothing"),
        F.col("l_quantity").cast("float").alias("short_float"), F.col("l_shipdate").alias("moment"))


def j34_edges(spark, d):
    return profile.data_snapshot(_edge_values(spark, d))


def j35_in_order(spark, d):
    return profile.ordered_unique_values(_lineitem(spark, d), P.PROFILE_COLUMNS)


def j35_edges_in_order(spark, d):
    frame = _edge_values(spark, d)
    return profile.ordered_unique_values(frame, frame.columns)


def j36(spark, d):
    return profile.top_n_values(_lineitem(spark, d), P.PROFILE_COLUMNS, P.TOP_VALUES)


def j36_counts(spark, d):
    return profile.top_value_counts(_lineitem(spark, d), P.PROFILE_COLUMNS, P.TOP_VALUES)


def j36_excluded(spark, d):
    frame = _lineitem(spark, d).withColumns({
        "never_given": F.lit(None).cast("string"), "at_times": F.when(F.col("l_linenumber") == 1, F.col("l_tax"))})
    return profile.all_null_columns(frame, [*P.PROFILE_COLUMNS, *P.DERIVED_COLUMNS])


def j37(spark, d):
    t = _t(spark, d)
    return lookups.currency_codes(t.invoice_header, t.currency, P.PAID_AFTER)


def j38(spark, d):
    return reports.satisfaction_by_month(_t(spark, d).survey, P.START, P.END)


def j39(spark, d):
    r = reports.receivables_by_status(_t(spark, d).receivables)
    return r.withColumn("total_amount", F.col("total_amount").cast("decimal(38,2)"))


def j40(spark, d):
    return reports.aging_outliers(_t(spark, d).aging(P.AS_OF))


def j41(spark, d):
    r = reports.vendor_payment_timeliness(_t(spark, d).vendor_payments, P.START, P.END)
    return r.withColumn("paid_amount", F.col("paid_amount").cast("decimal(38,2)"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "j01_latest_rate_in_window": j01,
    "j02_monthly_rates": j02,
    "j03_monthly_rates_by_rate_date": j03,
    "j04_to_usd": j04,
    "j04_to_usd_window_multiply": j04_window,
    "j05_dedupe_invoices": j05,
    "j06_valid_invoices": j06,
    "j07_dedupe_with_line_currency": j07,
    "j08_filter_supplier": j08,
    "j09_month_total_line_currency": j09,
    "j10_daily_totals": j10,
    "j11_enriched_invoices_basic": j11,
    "j11_enriched_invoices_all_lookups": j11_all_lookups,
    "j12_enriched_invoices": j12,
    "j13_total_millions": j13,
    "j13_total_millions_basic": j13_basic,
    "j14_monthly_trend_literal_exclusion": j14,
    "j15_monthly_trend": j15,
    "j15_monthly_trend_full_lookups": j15_full_lookups,
    "j16_po_numbers": j16,
    "j17_supplier_country": j17,
    "j18_naive_line_rate_total": j18,
    "j19_weighted_average_terms": j19,
    "j20_supplier_coverage": j20,
    "j21_problem_suppliers": j21,
    "j22_missing_invoices": j22,
    "j23_dedupe_ledger": j23,
    "j23_repair_control_totals": j23_control_totals,
    "j23_repaired_copy": j23_repaired_copy,
    "j24_duplicate_audit_invoice_supplier": j24,
    "j25_duplicate_audit_invoice_supplier_total": j25,
    "j26_keep_one_ledger": j26,
    "j27_side_by_side": j27,
    "j28_missing_rate_by_creator": j28,
    "j29_missing_rate_by_supplier": j29,
    "j30_coverage_by_tier": j30,
    "j30_coverage_by_tier_subset": j30_subset,
    "j31_coverage_by_supplier_name": j31,
    "j31_coverage_by_shipping_term": j31_shipping_term,
    "j32_coverage_by_currency_amounts": j32,
    "j33_coverage_sweep": j33,
    "j33_coverage_sweep_amounts": j33_amounts,
    "j33_isolated_sweep": j33_isolated,
    "j33_isolated_sweep_report": j33_report,
    "j31_match_labels": j31_match_labels,
    "j34_data_snapshot": j34,
    "j34_snapshot_edge_values": j34_edges,
    "j35_unique_values": j35,
    "j35_unique_values_in_order": j35_in_order,
    "j35_edge_values_in_order": j35_edges_in_order,
    "j36_top_n_values": j36,
    "j36_top_value_counts": j36_counts,
    "j36_excluded_columns": j36_excluded,
    "j37_currency_codes": j37,
    "j38_satisfaction_by_month": j38,
    "j39_receivables_by_status": j39,
    "j40_aging_outliers": j40,
    "j41_vendor_payment_timeliness": j41,
}


def _llm():
    """(queries, oracles) of the training-data operators, or two empty dicts where they are not installed."""
    try:
        import corpus_pipeline
        from apflow.llm import queries as llm
    except ImportError as err:  # the subpackage, the pipeline or a package they need is not installed
        log.warning("without the training-data operators: %s", err)
        return {}, {}

    oracles = llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**llm.QUERIES, "pipeline": corpus_pipeline.run}, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_llm()[0]}


def _dims() -> list[tuple[str, str, str]]:
    return [(d.table, d.column, d.display_name) for d in reconcile.REFERENCE_DIMENSIONS]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for each registered query (same column names)."""
    return {
        **_llm()[1],
        "j01_latest_rate_in_window": O.j01(),
        "j02_monthly_rates": O.j02(),
        "j03_monthly_rates_by_rate_date": O.j03(),
        "j04_to_usd": O.j04(),
        "j04_to_usd_window_multiply": O.j04_window(),
        "j05_dedupe_invoices": O.j05(),
        "j06_valid_invoices": O.j06(),
        "j07_dedupe_with_line_currency": O.j07(),
        "j08_filter_supplier": O.j08(),
        "j09_month_total_line_currency": O.j09(),
        "j10_daily_totals": O.j10(),
        "j11_enriched_invoices_basic": O.j11(),
        "j11_enriched_invoices_all_lookups": O.j11_all_lookups(),
        "j12_enriched_invoices": O.j12(),
        "j13_total_millions": O.j13(True),
        "j13_total_millions_basic": O.j13(False),
        "j14_monthly_trend_literal_exclusion": O.j14(),
        "j15_monthly_trend": O.j15(),
        "j15_monthly_trend_full_lookups": O.j15(),
        "j16_po_numbers": O.j16(),
        "j17_supplier_country": O.j17(),
        "j18_naive_line_rate_total": O.j18(),
        "j19_weighted_average_terms": O.j19(),
        "j20_supplier_coverage": O.j20(),
        "j21_problem_suppliers": O.j21(),
        "j22_missing_invoices": O.j22(),
        "j23_dedupe_ledger": O.j23(),
        "j23_repair_control_totals": O.j23_control_totals(),
        "j23_repaired_copy": O.j23(),
        "j24_duplicate_audit_invoice_supplier": O.j24(),
        "j25_duplicate_audit_invoice_supplier_total": O.j25(),
        "j26_keep_one_ledger": O.j26(),
        "j27_side_by_side": O.j27(),
        "j28_missing_rate_by_creator": O.j28(),
        "j29_missing_rate_by_supplier": O.j29(),
        "j30_coverage_by_tier": O.j30(False),
        "j30_coverage_by_tier_subset": O.j30(True),
        "j31_coverage_by_supplier_name": O.j31("B", "name", "Supplier: Supplier Name", 15,
                                               ["source_only_pct", "total_count"]),
        "j31_coverage_by_shipping_term": O.j31("B", "shipping_term_id", "Supplier: Shipping Term", None,
                                               ["total_count"], with_d=False),
        "j32_coverage_by_currency_amounts": O.j31("A", "currency_id", "Currency", 20,
                                                  ["source_only_total_usd_k"], amounts=True),
        "j33_coverage_sweep": O.j33(_dims(), 15, ["total_count"], False),
        "j33_coverage_sweep_amounts": O.j33(_dims(), 20, ["source_only_total_usd_k"], True),
        "j33_isolated_sweep": O.j33_isolated(_dims(), 15, ["total_count"]),
        "j33_isolated_sweep_report": O.j33_report(_dims(), [
            (f.table, f.column, f.display_name, status, reason) for f, status, reason in FAILING_DIMENSIONS]),
        "j31_match_labels": O.match_labels(),
        "j34_data_snapshot": O.j34(),
        "j34_snapshot_edge_values": O.j34_edges(),
        "j35_unique_values": O.j35(),
        "j35_unique_values_in_order": O.j35_in_order(),
        "j35_edge_values_in_order": O.j35_edges_in_order(),
        "j36_top_n_values": O.j36(),
        "j36_top_value_counts": O.j36_counts(),
        "j36_excluded_columns": O.j36_excluded(),
        "j37_currency_codes": O.j37(),
        "j38_satisfaction_by_month": O.j38(),
        "j39_receivables_by_status": O.j39(),
        "j40_aging_outliers": O.j40(),
        "j41_vendor_payment_timeliness": O.j41(),
    }
