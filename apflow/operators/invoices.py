"""Invoice and ledger grain: validity rules, de-duplication, duplicate audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.functions.dates import day_diff, in_window
from apflow.operators.joins import materialize, reduce_by_keys, where_not_in

# Fixed value: the longest plausible invoice-to-due and invoice-to-payment span, in days.
MAX_TERM_DAYS = 365
RULE_SETS = ("strict", "strict_no_currency", "loose", "ledger_compare", "window_only")
LEDGER_GRAIN = ("invoice__", "supplier", "payment_date", "requester", "total_usd", "invoice_date")
LEDGER_NEWEST = ("created_date", "invoice_received_date", "net_due_date")
LEDGER_COLUMNS = (
    "invoice__", "supplier", "supplier__", "payment_date", "requester", "total_usd",
    "invoice_date", "created_date", "invoice_received_date", "net_due_date",
)


def valid_invoices(
    headers: DataFrame,
    start: str | None,
    end: str | None,
    rules: str = "strict",
    excluded_currency: int | None = None,
    excluded_suppliers: Sequence[int] | DataFrame | None = None,
    date_cast: bool = False,
) -> DataFrame:
    """Invoices paid inside ``[start, end]`` that pass a named rule set.

    * ``strict``: not voided; due and paid on or after the invoice date and
      within 365 days of it; gross >= 0; currency != ``excluded_currency``.
    * ``strict_no_currency``: ``strict`` without the currency rule.
    * ``loose``: not voided, gross >= 0, currency rule.
    * ``ledger_compare``: document type 'Invoice' and not voided.
    * ``window_only``: the payment window alone.

    ``!=`` and ``NOT IN`` keep SQL's three-valued logic: a NULL status,
    currency or supplier fails the test and the row is dropped.
    ``excluded_suppliers`` may be a literal list or a one-column DataFrame
    (``NOT IN (subquery)``: NULL suppliers survive only when it is empty).
    """
    if rules not in RULE_SETS:
        raise ValueError(f"rules must be one of {RULE_SETS}")
    h = headers.where(in_window("payment_date", start, end, date_cast))
    conds: list[Column] = []
    if rules in ("strict", "strict_no_currency", "loose", "ledger_compare"):
        conds.append(F.col("status") != "Voided")
    if rules in ("strict", "strict_no_currency"):
        conds += [
            F.col("net_due_date") >= F.col("invoice_date"),
            day_diff("invoice_date", "net_due_date") <= MAX_TERM_DAYS,
            F.col("payment_date") >= F.col("invoice_date"),
            day_diff("invoice_date", "payment_date") <= MAX_TERM_DAYS,
        ]
    if rules in ("strict", "strict_no_currency", "loose"):
        conds.append(F.col("gross_total") >= 0)
    if rules in ("strict", "loose") and excluded_currency is not None:
        conds.append(F.col("currency_id") != excluded_currency)
    if rules == "ledger_compare":
        conds.append(F.col("document_type") == "Invoice")
    if conds:
        h = h.where(reduce(lambda a, b: a & b, conds))
    if excluded_suppliers is not None:
        if isinstance(excluded_suppliers, DataFrame):
            h = where_not_in(h, "supplier_id", excluded_suppliers)
        else:
            h = h.where(~F.col("supplier_id").isin(list(excluded_suppliers)))
    return h


def dedupe_invoices(
    headers: DataFrame, key: str = "invoice_number", amount: str = "gross_total", tie: str = "id"
) -> DataFrame:
    """One row per invoice number, the largest ``amount`` winning.

    The dialect puts a NULL amount first on DESC; equal amounts go to the
    smallest ``tie``. NULL numbers form one group like any other value
    (callers that drop them later may filter first; the groups are
    independent). Planned as a partial WindowGroupLimit, a shuffle of at most
    one row per key per map task, then a final limit.
    """
    w = Window.partitionBy(key).orderBy(F.col(amount).desc_nulls_first(), F.col(tie).asc_nulls_last())
    return headers.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def dedupe_with_line_currency(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """De-duplicate headers with the currency taken from one of their lines.

    -> invoice_number, payment_date, gross_total, currency_id

    The reference joins every line and keeps one joined row per number, so the
    currency comes from an arbitrary line; here it is the line with the
    smallest ``line_num``. Headers are de-duplicated first and written; lines
    of other headers are dropped in the map tasks (:func:`reduce_by_keys`),
    and what is left is reduced to one row per header with a partial aggregate
    *before* the join, so the join is 1:1. A header without lines keeps a NULL
    currency.
    """
    deduped = materialize(dedupe_invoices(headers.select("id", "invoice_number", "payment_date", "gross_total")))
    first_line = reduce_by_keys(lines, "invoice_header_id", deduped.select("id")).groupBy("invoice_header_id").agg(
        F.min_by("currency_id", "line_num").alias("line_currency_id")
    )
    joined = deduped.join(first_line, deduped.id == first_line.invoice_header_id, "left")
    return joined.select(
        "invoice_number", "payment_date", "gross_total", F.col("line_currency_id").alias("currency_id")
    )


def filter_supplier(invoices: DataFrame) -> DataFrame:
    """Drop invoices without a supplier (applied after de-duplication)."""
    return invoices.where(F.col("supplier_id").isNotNull())


def dedupe_ledger(ledger: DataFrame) -> DataFrame:
    """Keep the newest row of each six-column ledger grain.

    Newest = latest created, then received, then due date, a NULL date
    counting as newest (the dialect sorts NULL first on DESC); the smallest
    ``supplier__`` breaks a remaining tie. Written as one aggregate per grain
    with ``min_by`` over an ordering key rather than a ranked window: a hot
    grain is combined map-side, and when a caller reads only grain columns
    (the reconciliation match counts) Catalyst prunes the ``min_by`` and the
    repair becomes a hash distinct with no sort at all.
    """
    rest = [c for c in ledger.columns if c not in LEDGER_GRAIN]

    def newest_first(c: str) -> list[Column]:
        # min over (not null, -days): NULL first, then the latest date
        return [F.col(c).isNotNull(), -F.unix_date(F.to_date(F.col(c)))]

    key = F.struct(
        *[x for c in LEDGER_NEWEST for x in newest_first(c)],
        F.col("supplier__").isNull(),
        F.col("supplier__"),
    )
    picked = ledger.groupBy(*LEDGER_GRAIN).agg(F.min_by(F.struct(*rest), key).alias("_w"))
    return picked.select(*[c if c in LEDGER_GRAIN else F.col(f"_w.{c}").alias(c) for c in ledger.columns])


def duplicate_audit(ledger: DataFrame, keys: Sequence[str], after: str | None) -> DataFrame:
    """Every ledger row (any date) whose invoice number is duplicated.

    A number is duplicated when some group of ``keys`` among rows paid after
    ``after`` has more than one row. The group counts are a partial aggregate
    and the membership test a left semi join, so no group is gathered whole; the
    numbers get an exchange of their own, so that the join can split a hot one.
    Sorted by number, supplier, payment date, requester and total (NULLs last),
    remaining columns breaking ties.
    """
    recent = ledger if after is None else ledger.where(F.col("payment_date") > F.lit(after))
    dup_numbers = (
        recent.groupBy(*keys).count().where(F.col("count") > 1).select("invoice__").distinct().hint("rebalance")
    )
    rows = ledger.join(dup_numbers, "invoice__", "left_semi")
    first = ["invoice__", "supplier", "payment_date", "requester", "total_usd"]
    rest = [c for c in LEDGER_COLUMNS if c not in first]
    return rows.orderBy(*[F.col(c).asc_nulls_last() for c in first + rest])


def keep_one_ledger(ledger: DataFrame, after: str | None, keys: Sequence[str] = ("invoice__", "supplier", "total_usd")) -> DataFrame:
    """One row per (number, supplier, total) among rows paid after ``after``.

    The reference keeps an arbitrary survivor; here the earliest row by the
    remaining columns wins, so the output is deterministic.
    """
    recent = ledger if after is None else ledger.where(F.col("payment_date") > F.lit(after))
    rest = [c for c in LEDGER_COLUMNS if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in rest])
    return recent.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def repair_control_totals(backup: DataFrame, repaired: DataFrame) -> DataFrame:
    """Before/after control totals of a ledger repair, per payment month.

    -> payment_month, rows_before, rows_after, rows_removed, total_before, total_after.
    Two partial aggregates joined on the month (one row per month each side).
    """
    def totals(df: DataFrame, suffix: str) -> DataFrame:
        return df.groupBy(F.date_format("payment_date", "yyyy-MM").alias("payment_month")).agg(
            F.count(F.lit(1)).alias(f"rows_{suffix}"),
            F.sum("total_usd").cast("decimal(38,2)").alias(f"total_{suffix}"),
        )

    b = totals(backup, "before")
    a = totals(repaired, "after").withColumnRenamed("payment_month", "_m")
    # NULL months (no payment date) are one group on each side: null-safe match
    j = b.join(a, b.payment_month.eqNullSafe(a._m), "full")
    return j.select(
        F.coalesce("payment_month", "_m").alias("payment_month"),
        F.coalesce("rows_before", F.lit(0)).alias("rows_before"),
        F.coalesce("rows_after", F.lit(0)).alias("rows_after"),
        (F.coalesce("rows_before", F.lit(0)) - F.coalesce("rows_after", F.lit(0))).alias("rows_removed"),
        "total_before",
        "total_after",
    )
