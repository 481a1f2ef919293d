"""Payables in USD: invoice-level fact, totals, trends, weighted terms.

The invoice fact (J11/J12) is one plan: filter -> de-duplicate (one shuffle on
the invoice number) -> rate join (broadcast after a size check) -> lookups
(tiny dimensions broadcast by Catalyst from file statistics; supplier-sized
ones left to sort-merge or AQE) -> measures. Trends and totals aggregate it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.functions.dates import month_label
from apflow.functions.measures import (
    DEFAULT_IMMEDIATE_TERMS,
    bucket_amounts,
    payment_term_days,
    region_of,
)
from apflow.functions.measures import to_usd as usd_expr
from apflow.operators.invoices import (
    dedupe_invoices,
    dedupe_with_line_currency,
    filter_supplier,
    valid_invoices,
)
from apflow.operators.joins import join_dimension, materialize, reduce_by_keys
from apflow.operators.lookups import po_numbers, supplier_country
from apflow.operators.rates import latest_rate_in_window, monthly_rates
from apflow.sources.fixtures import APTables

# The intake channels the reference leaves out of the monthly trend.
EXCLUDED_CHANNELS = ("api", "cxml")


@dataclass(frozen=True)
class FactSpec:
    """Which variant of the invoice fact to build.

    ``rates='monthly'`` joins the newest rate of the payment month (v2/v3);
    ``rates='window'`` joins the newest rate inside ``[start, end]`` (v1).
    ``lookups=False`` skips the descriptive joins; every lookup is keyed on
    its table's primary key (or reduced to one row per key), so skipping them
    changes no row and no measure.
    """

    start: str | None
    end: str | None
    rules: str = "loose"
    rates: str = "monthly"
    base: int | None = 1
    since: str | None = None
    excluded_currency: int | None = None
    excluded_suppliers: Sequence[int] | DataFrame | None = None
    require_supplier: bool = False
    lookups: bool = True
    variant: str = "v3"  # 'v3' (PO, country, vendor name, channel) or 'basic' (J11 columns)
    region_map: Mapping[str, str] = field(default_factory=dict)
    immediate_terms: Sequence[str] = DEFAULT_IMMEDIATE_TERMS


def _rated(t: APTables, inv: DataFrame, spec: FactSpec) -> DataFrame:
    """Left-join one rate per invoice; ``rate`` becomes ``coalesce(rate, 1)``."""
    if spec.rates == "monthly":
        r = monthly_rates(t.exchange_rate, spec.base, spec.since).select(
            F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate"), F.col("rate_month").alias("_rm")
        )
        inv = inv.withColumn("_im", F.trunc(F.to_date("payment_date"), "month"))
        keys = [("currency_id", "_ccy"), ("_im", "_rm")]
    elif spec.rates == "window":
        r = latest_rate_in_window(t.exchange_rate, spec.base, spec.start, spec.end).select(
            F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate")
        )
        keys = [("currency_id", "_ccy")]
    else:
        raise ValueError("rates must be 'monthly' or 'window'")
    j = join_dimension(inv, r, keys, "left", written=t.written)
    return j.withColumn("rate", F.coalesce(F.col("_rate"), F.lit(1.0))).drop("_ccy", "_rate", "_rm", "_im")


def invoice_fact(t: APTables, spec: FactSpec) -> DataFrame:
    """One row per de-duplicated invoice with the measure catalogue."""
    inv = valid_invoices(
        t.invoice_header,
        spec.start,
        spec.end,
        spec.rules,
        excluded_currency=spec.excluded_currency,
        excluded_suppliers=spec.excluded_suppliers,
    )
    inv = dedupe_invoices(inv)
    if spec.require_supplier:
        inv = filter_supplier(inv)
    inv = inv.select(
        "id", "invoice_number", "payment_date", "gross_total", "currency_id", "supplier_id",
        "payment_term_id", "account_type_id", "channel",
        F.to_date("invoice_date").alias("invoice_date"),
        F.to_date("net_due_date").alias("net_due_date"),
        F.to_date("date_received").alias("invoice_received_date"),
        F.to_date("created_at").alias("created_date"),
    )
    lines = None
    if spec.lookups and spec.variant != "basic":
        # written once: the surviving ids choose the lines of the PO lookup before those are shuffled
        inv = materialize(inv)
        lines = reduce_by_keys(t.invoice_line, "invoice_header_id", inv.where(F.col("invoice_number").isNotNull()).select("id"))
    j = _rated(t, inv, spec)
    # Drop NULL numbers before the lookups: the reference drops them at the end
    # and no lookup depends on them.
    j = j.where(F.col("invoice_number").isNotNull())
    usd = usd_expr("gross_total", "rate", "divide", "one")
    measures = bucket_amounts(usd, "invoice_date", "net_due_date", "payment_date")

    if not spec.lookups:
        cols = ["payment_date", "invoice_number", "gross_total", "invoice_date", "net_due_date",
                "invoice_received_date", "created_date", "channel", "rate", "supplier_id"]
        return j.select(*cols, *[c.alias(n) for n, c in measures.items()])

    cur = t.currency.select(F.col("id").alias("_cur_id"), "code")
    pt = t.payment_term.select(F.col("id").alias("_pt_id"), F.col("code").alias("payment_terms"))
    at = t.account_type.select(F.col("id").alias("_at_id"), F.col("name").alias("account_type_name"))
    j = (
        j.join(cur, j.currency_id == cur._cur_id, "left")
        .join(pt, j.payment_term_id == pt._pt_id, "left")
        .join(at, j.account_type_id == at._at_id, "left")
    )
    if spec.variant == "basic":
        si = t.supplier_information.select(F.col("id").alias("_si_id"))
        j = j.join(si, j.supplier_id == si._si_id, "left")
        head = ["payment_date", "invoice_number", "gross_total", "invoice_date", "net_due_date",
                "invoice_received_date", "created_date", "rate", "code",
                F.col("_si_id").alias("supplier_id"), "payment_terms", "account_type_name"]
    else:
        si = t.supplier_information.select(F.col("id").alias("_si_id"), F.col("name").alias("vendor_name"))
        sl = supplier_country(t.supplier_address, t.country).select(F.col("id").alias("_sl_id"), "country")
        po = po_numbers(lines, t.order_line, t.order_header).select(
            F.col("invoice_header_id").alias("_po_id"), "po_number"
        )
        j = (
            j.join(si, j.supplier_id == si._si_id, "left")
            # an exchange of its own, so that the join can split a hot supplier
            .join(sl.hint("rebalance"), j.supplier_id == sl._sl_id, "left")
            .join(po, j.id == po._po_id, "left")
        )
        head = ["payment_date", "invoice_number", "po_number", "gross_total", "invoice_date", "net_due_date",
                "invoice_received_date", "created_date", "channel", "rate", "code", "vendor_name", "country",
                "payment_terms", "account_type_name"]
    return j.select(
        *head,
        region_of("account_type_name", spec.region_map).alias("region"),
        payment_term_days("payment_terms", spec.immediate_terms).alias("payment_term_days"),
        *[c.alias(n) for n, c in measures.items()],
    )


def monthly_trend(fact: DataFrame, excluded_channels: Sequence[str] = EXCLUDED_CHANNELS) -> DataFrame:
    """J14/J15 report: per payment month, count, USD millions, WAT and WADTP days.

    The channel filter runs after de-duplication, as in the reference; a NULL
    channel fails ``NOT IN`` and is dropped.
    """
    f = fact.where(F.col("payment_date").isNotNull() & ~F.col("channel").isin(list(excluded_channels)))
    total = F.sum("total_usd")
    return (
        f.groupBy(month_label("payment_date").alias("payment_month"))
        .agg(
            F.count(F.lit(1)).alias("invoice_count"),
            F.round(total / F.lit(1000000), 2).alias("amount_due_usd_millions"),
            F.round(F.sum("wat") / F.nullif(total, F.lit(0)), 1).alias("wat_days"),
            F.round(F.sum("wadtp") / F.nullif(total, F.lit(0)), 1).alias("wadtp_days"),
        )
        .orderBy(F.col("payment_month").asc_nulls_last())
    )


def total_millions(fact: DataFrame) -> DataFrame:
    """Sum of per-invoice USD in millions."""
    return fact.agg((F.sum("total_usd") / F.lit(1000000)).alias("amount_due_usd_millions"))


def month_total_line_currency(t: APTables, start: str, end: str, base: int = 1) -> DataFrame:
    """Distinct numbers, rows and USD total, currency taken from a line.

    A NULL rate is not replaced: the row stays in the counts and drops out of
    the sum.
    """
    rates = latest_rate_in_window(t.exchange_rate, base, start, end).select(
        F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate")
    )
    inv = valid_invoices(t.invoice_header, start, end, "strict_no_currency")
    d = dedupe_with_line_currency(inv, t.invoice_line)
    j = join_dimension(d, rates, [("currency_id", "_ccy")], "left", written=t.written)
    usd = usd_expr("gross_total", "_rate", "divide", "null")
    return j.agg(
        F.count_distinct("invoice_number").alias("unique_invoice_numbers"),
        F.count(F.lit(1)).alias("total_invoices"),
        F.round(F.sum(usd), 0).alias("amount_due_usd"),
    )


def daily_totals(t: APTables, start: str, end: str, base: int = 1, excluded_currency: int | None = None) -> DataFrame:
    """Per payment day, distinct numbers, rows and USD millions (header currency)."""
    spec = FactSpec(start, end, rules="strict", rates="window", base=base, excluded_currency=excluded_currency)
    inv = valid_invoices(t.invoice_header, start, end, "strict", excluded_currency=excluded_currency)
    inv = dedupe_invoices(inv).select("invoice_number", "payment_date", "gross_total", "currency_id")
    j = _rated(t, inv, spec)
    usd = usd_expr("gross_total", "rate", "divide", "one")
    return (
        j.groupBy(F.to_date("payment_date").alias("payment_day"))
        .agg(
            F.count_distinct("invoice_number").alias("unique_invoice_numbers"),
            F.count(F.lit(1)).alias("total_invoices"),
            (F.round(F.sum(usd), 0) / F.lit(1000000)).alias("amount_due_usd"),
        )
        .orderBy(F.col("payment_day").asc_nulls_last())
    )


def naive_line_rate_total(t: APTables, paid_after: str, base: int = 1) -> DataFrame:
    """Header -> every line -> every rate row of the line's currency.

    The reference's join keeps the fan-out (lines x rate rows), which grows
    quadratically with scale. The same three numbers come from rates reduced
    to (count, sum) per currency first: rows = sum of counts, amount = sum of
    amount_due x rate sum. Rates are summed as DECIMAL(18,8) so the total is
    exact; the result is DECIMAL(38,2).
    """
    r = (
        t.exchange_rate.where(F.col("from_currency_id") == base)
        .groupBy("to_currency_id")
        .agg(
            F.count(F.lit(1)).alias("_n_rates"),
            F.sum(F.col("rate").cast("decimal(18,8)")).cast("decimal(20,8)").alias("_sum_rate"),
        )
    )
    h = t.invoice_header.where(F.col("payment_date") > F.lit(paid_after)).select("id", "invoice_number", "amount_due")
    li = t.invoice_line.select("invoice_header_id", "currency_id")
    # one row per currency: lines are not shuffled on the currency
    lr = join_dimension(li, r, [("currency_id", "to_currency_id")], "inner", written=t.written)
    j = h.join(lr, h.id == lr.invoice_header_id, "inner")
    return j.agg(
        F.count_distinct("invoice_number").alias("unique_invoice_numbers"),
        F.sum("_n_rates").alias("total_invoices"),
        F.sum(F.col("amount_due") * F.col("_sum_rate")).cast("decimal(38,2)").alias("amount_due_usd"),
    )


def weighted_average_terms(t: APTables, status: str = "APPROVED") -> DataFrame:
    """Amount- and rate-weighted average of the payment-term days.

    Each approved invoice with ``amount_due > 0`` meets every rate row of its
    currency (any base), or one row of rate 1 when there is none; NULL days
    count as 0. Rates are reduced to a per-currency sum first, so the fan-out
    is never built. Rounded to 6 decimals.
    """
    r = t.exchange_rate.groupBy("to_currency_id").agg(F.sum(F.coalesce("rate", F.lit(1.0))).alias("_sum_rate"))
    pt = t.payment_term.select(F.col("id").alias("_pt_id"), "days_for_net_payment")
    h = t.invoice_header.where((F.col("status") == status) & (F.col("amount_due") > 0))
    j = h.join(pt, h.payment_term_id == pt._pt_id, "left")
    j = join_dimension(j, r, [("currency_id", "to_currency_id")], "left", written=t.written)
    w = F.coalesce(F.col("amount_due").cast("double"), F.lit(0.0)) * F.coalesce(F.col("_sum_rate"), F.lit(1.0))
    days = F.coalesce(F.col("days_for_net_payment").cast("double"), F.lit(0.0))
    return j.agg(F.round(F.sum(w * days) / F.nullif(F.sum(w), F.lit(0.0)), 6).alias("wat"))
