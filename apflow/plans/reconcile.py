"""Reconciliation of source invoices against the finance ledger.

The reference joins invoices to the (non-unique) ledger and counts the joined
rows, so an invoice matched by k ledger rows counts k times. Here the ledger is
first reduced to one row per invoice number with its match count ``k`` (a
partial aggregate: a hot number becomes one row per map task), and the join is
many-to-one. Every count and sum is then a weighted sum over invoices:

* rows in both systems      = sum(k)                 (k >= 1)
* rows only in the source   = sum(1 if k is NULL)
* all joined rows           = sum(coalesce(k, 1))

which equals the reference's fan-out counts exactly, without building the
product of a hot invoice number's rows on both sides.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.functions.dates import in_window, month_start
from apflow.functions.measures import to_usd as usd_expr
from apflow.operators.invoices import dedupe_invoices, keep_one_ledger, valid_invoices
from apflow.operators.joins import WrittenTables, join_dimension, left_join_many, materialize
from apflow.operators.rates import monthly_rates, monthly_rates_by_rate_date
from apflow.sources.fixtures import APTables

log = logging.getLogger(__name__)

# Labels of the match indicator; callers may pass their own.
BOTH, SOURCE_ONLY = "BOTH", "SOURCE ONLY"


def ledger_match_counts(ledger: DataFrame, key: str = "invoice__") -> DataFrame:
    """Ledger rows per invoice number -> ``_match_key``, ``_k`` (NULL numbers never match)."""
    return (
        ledger.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_match_key"))
        .agg(F.count(F.lit(1)).alias("_k"))
    )


MATCH_POLICIES = ("fanout", "exists")


def with_match_count(
    invoices: DataFrame, ledger: DataFrame, number: str = "invoice_number", match: str = "fanout"
) -> DataFrame:
    """Left-join the ledger match count ``_k`` (NULL when unmatched).

    ``match='fanout'`` (the reference's behaviour) counts an invoice once per
    matching ledger row; ``match='exists'`` counts a matched invoice once.
    """
    if match not in MATCH_POLICIES:
        raise ValueError(f"match must be one of {MATCH_POLICIES}")
    # spread once more after the aggregate: only a join with a plain exchange on either side
    # lets AQE split a hot number
    m = ledger_match_counts(ledger).hint("rebalance")
    if match == "exists":
        m = m.select("_match_key", F.lit(1).cast("bigint").alias("_k"))
    return invoices.join(m, invoices[number] == m._match_key, "left").drop("_match_key")


def with_match_label(
    invoices: DataFrame, ledger: DataFrame, number: str = "invoice_number", labels: tuple[str, str] = (BOTH, SOURCE_ONLY)
) -> DataFrame:
    """``invoices`` with ``match_label`` (in both systems, or in the source alone) and ``ledger_rows``.

    The reference's match indicator, one row per invoice instead of one per joined pair: the
    pairs of an invoice are alike but for their ledger side, and ``ledger_rows`` says how many there are.
    """
    m = with_match_count(invoices, ledger, number)
    label = F.when(_k().isNotNull(), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return m.withColumn("match_label", label).withColumn("ledger_rows", _in_both()).drop("_k")


def match_labels(t: APTables, start: str, end: str, ledger_period: DataFrame) -> DataFrame:
    """The match indicator of every source invoice paid in the window, against one period of the ledger.

    -> id, invoice_number, supplier_id, match_label, ledger_rows
    """
    h = t.invoice_header.where(in_window("payment_date", start, end, date_cast=True))
    return with_match_label(h.select("id", "invoice_number", "supplier_id"), ledger_period)


def _k() -> Column:
    return F.col("_k")


def _in_both() -> Column:
    return F.coalesce(_k(), F.lit(0))


def _source_only_rows() -> Column:
    return F.when(_k().isNull(), F.lit(1)).otherwise(F.lit(0))


def _all_rows() -> Column:
    return F.coalesce(_k(), F.lit(1))


def _pct(part: Column, total: Column) -> Column:
    return F.round(part.cast("double") * F.lit(100.0) / total, 2)


# ------------------------------------------------------------------ J20, J21
def supplier_coverage(
    headers: DataFrame, ledger: DataFrame, suppliers: DataFrame, start: str | None, end: str | None,
    match: str = "fanout",
) -> DataFrame:
    """Per supplier, invoices only in the source, in both, total, % only.

    -> supplier_id, only_in_source, present_in_both, total_invoices, pct_only_in_source
    """
    h = headers.where(in_window("payment_date", start, end)).select("invoice_number", "supplier_id")
    h = with_match_count(h, ledger, match=match)
    s = suppliers.select(F.col("id").alias("_sid"))
    j = h.join(s, h.supplier_id == s._sid, "inner")
    only, both, total = F.sum(_source_only_rows()), F.sum(_in_both()), F.sum(_all_rows())
    return j.groupBy(F.col("_sid").alias("supplier_id")).agg(
        only.alias("only_in_source"),
        both.alias("present_in_both"),
        total.alias("total_invoices"),
        (only.cast("double") * F.lit(100.0) / F.nullif(total, F.lit(0))).alias("pct_only_in_source"),
    )


def problem_suppliers(
    metrics: DataFrame, min_pct: float = 90.0, top: int = 40, materialized: bool = True, written: WrittenTables | None = None
) -> DataFrame:
    """The ``top`` largest suppliers (by invoices) with more than ``min_pct`` % missing.

    Ties on the invoice count go to the smaller supplier id. Planned as a
    TakeOrderedAndProject, so the result is bounded by ``top`` and safe to
    broadcast into a ``NOT IN``. By default the (at most ``top``) ids are
    written once under the checkpoint folder: Catalyst copies a ``NOT IN``
    filter into every lookup joined on the supplier, and each copy then reads
    the small written table instead of re-planning the coverage pipeline. With ``written`` they are
    written once for all jobs that share it.
    """
    ids = (
        metrics.where(F.col("pct_only_in_source") > min_pct)
        .orderBy(F.col("total_invoices").desc_nulls_first(), F.col("supplier_id").asc_nulls_last())
        .limit(top)
        .select("supplier_id")
    )
    return (written or WrittenTables()).get(ids, small=True)[0] if materialized else ids


# ----------------------------------------------------------------------- J22
def without_match(invoices: DataFrame, ledger: DataFrame, number: str = "invoice_number") -> DataFrame:
    """The invoices with no ledger row; NULL numbers never match and stay."""
    # spread once more after the distinct, as in with_match_count
    keys = ledger.select(F.col("invoice__").alias("_key")).where(F.col("_key").isNotNull()).distinct().hint("rebalance")
    return invoices.join(keys, invoices[number] == keys._key, "left_anti")


def missing_invoices(t: APTables, start: str, end: str) -> DataFrame:
    """Source invoices paid in the window with no ledger row at all.

    -> invoice_number, name, gross_total_usd, payment_date. USD is
    ``rate x gross`` with the month's rate keyed on ``rate_date`` (J03), NULL
    when there is none. NULL invoice numbers never match and are listed.
    """
    h = without_match(t.invoice_header.where(in_window("payment_date", start, end)), t.ledger)
    s = t.supplier_dim.select(F.col("id").alias("_sid"), "name")
    r = monthly_rates_by_rate_date(t.exchange_rate).select(
        F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate"), F.col("rate_date_month").alias("_rm")
    )
    h = h.withColumn("_pm", month_start("payment_date")).join(s, h.supplier_id == s._sid, "left")
    j = join_dimension(h, r, [("currency_id", "_ccy"), ("_pm", "_rm")], "left", written=t.written)
    return j.select(
        "invoice_number",
        "name",
        usd_expr("gross_total", "_rate", "multiply", "null").alias("gross_total_usd"),
        F.to_date("payment_date").alias("payment_date"),
    ).orderBy(F.col("payment_date").asc_nulls_last(), F.col("invoice_number").asc_nulls_last())


# ----------------------------------------------------------------------- J27
def side_by_side(
    t: APTables, start: str, end: str, rates_since: str | None, ledger_after: str | None, base: int = 1
) -> DataFrame:
    """Each de-duplicated source invoice next to its ledger rows (if any).

    The lookups are joined while there is one row per invoice; the ledger rows come last, in a join that salts
    numbers with very many of them. They are written once, as that join reads them twice.
    """
    rates = monthly_rates(t.exchange_rate, base, rates_since).select(
        F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate"), F.col("rate_month").alias("_rm")
    )
    sandbox = materialize(keep_one_ledger(t.ledger, ledger_after).select(
        F.col("invoice__").alias("ledger_invoice_number"),
        F.col("supplier").alias("ledger_vendor_name"),
        F.col("supplier__").alias("ledger_supplier_number"),
        F.col("payment_date").alias("ledger_payment_date"),
        F.col("total_usd").alias("ledger_total_usd"),
    ))
    src = dedupe_invoices(valid_invoices(t.invoice_header, start, end, "ledger_compare"))
    cur = t.currency.select(F.col("id").alias("_cur_id"), "code")
    sup = t.supplier_dim.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"), F.col("number").alias("_snum"))
    a = src.join(cur, src.currency_id == cur._cur_id, "left").withColumn("_pm", month_start("payment_date"))
    j = a.join(sup, a.supplier_id == sup._sid, "left")
    j = join_dimension(j, rates, [("currency_id", "_ccy"), ("_pm", "_rm")], "left", written=t.written)
    j = left_join_many(j, sandbox, "invoice_number", "ledger_invoice_number")
    return j.select(
        F.col("invoice_number").alias("source_invoice_number"),
        F.col("code").alias("source_currency_code"),
        F.col("_sname").alias("source_vendor_name"),
        F.col("_snum").alias("source_supplier_number"),
        F.to_date("payment_date").alias("source_payment_date"),
        F.round(usd_expr("gross_total", "_rate", "divide", "one"), 2).alias("source_total_usd"),
        "ledger_invoice_number",
        "ledger_vendor_name",
        "ledger_supplier_number",
        "ledger_payment_date",
        "ledger_total_usd",
    ).orderBy(F.col("source_payment_date").asc_nulls_last())


# ------------------------------------------------------------------ J28, J29
def _missing_rate(t: APTables, by: str, start: str, end: str, min_invoices: int, match: str = "fanout") -> DataFrame:
    h = t.invoice_header.where(in_window("payment_date", start, end, date_cast=True) & F.col("paid"))
    h = with_match_count(h.select("invoice_number", by), t.ledger, match=match)
    missing_row = F.when(_k().isNull() & F.col("invoice_number").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    total, missing = F.sum(_all_rows()), F.sum(missing_row)
    g = h.groupBy(by).agg(total.alias("total_invoices"), missing.alias("missing_invoices"))
    g = g.where(F.col("total_invoices") >= min_invoices)
    matched = F.col("total_invoices") - F.col("missing_invoices")
    return g.select(
        by,
        "total_invoices",
        "missing_invoices",
        matched.alias("matched_invoices"),
        _pct(F.col("missing_invoices"), F.col("total_invoices")).alias("missing_rate_pct"),
        _pct(matched, F.col("total_invoices")).alias("match_rate_pct"),
    )


def missing_rate_by_creator(
    t: APTables, start: str, end: str, min_invoices: int = 10, match: str = "fanout"
) -> DataFrame:
    """Per creator, paid invoices missing from / matched in the ledger (>= ``min_invoices``).

    An invoice without a number counts as matched, as in the reference.
    """
    return _missing_rate(t, "created_by_id", start, end, min_invoices, match).orderBy(
        F.col("missing_rate_pct").desc_nulls_first()
    )


def missing_rate_by_supplier(
    t: APTables, start: str, end: str, min_invoices: int = 10, match: str = "fanout"
) -> DataFrame:
    """J28 per supplier plus grand totals over the listed suppliers.

    The grand totals are one scalar subquery (a one-row aggregate broadcast
    as a value), not a window over a single partition. The rates per supplier
    are written once, since both the list and the totals read them.
    """
    s = materialize(_missing_rate(t, "supplier_id", start, end, min_invoices, match))
    tot = s.agg(
        F.struct(
            F.sum("total_invoices").alias("t"),
            F.sum("missing_invoices").alias("m"),
            F.sum("matched_invoices").alias("k"),
        )
    ).scalar()
    return s.select(
        "*",
        tot["t"].alias("grand_total_invoices"),
        tot["m"].alias("grand_total_missing"),
        tot["k"].alias("grand_total_matched"),
        _pct(tot["m"], tot["t"]).alias("overall_missing_rate_pct"),
    ).orderBy(F.col("missing_rate_pct").desc_nulls_first())


# ----------------------------------------------------------------- J30 - J33
def _coverage_columns() -> list[Column]:
    both, only = F.sum(_in_both()), F.sum(_source_only_rows())
    total = F.sum(_all_rows())
    return [
        both.alias("both_count"),
        only.alias("source_only_count"),
        total.alias("total_count"),
        _pct(both, total).alias("both_pct"),
        _pct(only, total).alias("source_only_pct"),
    ]


def _amount_columns() -> list[Column]:
    amt = F.col("_amount_usd")
    both = F.coalesce(F.sum(F.when(_k().isNotNull(), amt * _k())), F.lit(0.0))
    only = F.coalesce(F.sum(F.when(_k().isNull(), amt)), F.lit(0.0))
    total = F.sum(amt * _all_rows())
    return [
        F.round(both / F.lit(1000), 1).alias("both_total_usd_k"),
        F.round(only / F.lit(1000), 1).alias("source_only_total_usd_k"),
        F.round(total / F.lit(1000), 1).alias("total_usd_k"),
    ]


def supplier_tiers(suppliers: DataFrame, key: str = "supplier-tier") -> DataFrame:
    """Flatten the supplier's JSON ``custom_fields`` and keep one key's ``name``.

    -> supplier_id, supplier_tier_value
    """
    kv = suppliers.select(
        F.col("id").alias("supplier_id"),
        F.explode(F.from_json("custom_fields", "map<string,string>")).alias("_key", "_value"),
    )
    return kv.where(F.col("_key") == key).select(
        "supplier_id", F.get_json_object("_value", "$.name").alias("supplier_tier_value")
    )


def coverage_by_tier(
    t: APTables, start: str, end: str, ledger_period: DataFrame, suppliers_in: Sequence[int] | None = None,
    match: str = "fanout",
) -> DataFrame:
    """Match coverage per supplier tier (from the JSON custom fields).

    Suppliers without a tier form the NULL row. ``suppliers_in`` restricts the
    invoices to a list of supplier ids.
    """
    a = t.invoice_header.where(in_window("payment_date", start, end, date_cast=True))
    if suppliers_in is not None:
        a = a.where(F.col("supplier_id").isin(list(suppliers_in)))
    b = t.supplier_dim.select(F.col("id").alias("_bid"))
    st = supplier_tiers(t.supplier_dim).withColumnRenamed("supplier_id", "_st_id")
    j = a.select("invoice_number", "supplier_id").join(b, F.col("supplier_id") == b._bid, "inner")
    j = j.join(st, j._bid == st._st_id, "left")
    j = with_match_count(j, ledger_period, match=match)
    return j.groupBy("supplier_tier_value").agg(*_coverage_columns()).orderBy(F.col("total_count").desc_nulls_first())


@dataclass(frozen=True)
class Dimension:
    """A candidate explanation of the gap: ``table`` is A (invoice), B (supplier) or D (supplier info).

    ``invalid`` is for an expression that gives NULL where its input cannot be read: a SQL condition
    that is true on just those rows, so that the sweep's report can count them.
    """

    table: str
    column: str
    display_name: str
    expr: str | None = None  # SQL expression when the value is not a plain column
    invalid: str | None = None

    def sql(self) -> str:
        """The value as a SQL expression over the prefixed columns."""
        return self.expr if self.expr is not None else f"`{self.table}_{self.column}`"

    def value(self) -> Column:
        return F.expr(self.sql())


def json_dimension(table: str, column: str, path: str, name: str, display_name: str) -> Dimension:
    """A value inside a JSON text column; a text that is no JSON has no value and counts as invalid."""
    doc = f"try_parse_json(`{table}_{column}`)"
    return Dimension(
        table, name, display_name, expr=f"try_variant_get({doc}, {_q(path)}, 'string')",
        invalid=f"`{table}_{column}` IS NOT NULL AND {doc} IS NULL",
    )


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The dimensions the reference sweeps, in its order
# (table alias, column, display name).
REFERENCE_DIMENSIONS = [
    Dimension("B", "shipping_term_id", "Supplier: Shipping Term"),
    Dimension("B", "payment_term_id", "Supplier: Payment Term"),
    Dimension("B", "send_invoices_to_approvals", "Supplier: Send Invoices to Approvals"),
    Dimension("B", "po_method", "Supplier: PO Method"),
    Dimension("A", "account_type_id", "Invoice: Account Type"),
    Dimension("A", "status", "Invoice: Status"),
    Dimension("A", "channel", "Invoice: Channel"),
    Dimension("A", "payment_channel", "Invoice: Payment Channel"),
    Dimension("B", "name", "Supplier: Supplier Name"),
    Dimension("A", "account_type_id", "Invoice :Buyer"),
    Dimension("A", "requested_by_id", "Invoice Requester"),
    Dimension("A", "created_by_id", "Invoice : Owner"),
    Dimension("A", "currency_id", "Currency"),
    Dimension("D", "federal_tax_num", "Supplier: Fed Tax ID"),
    Dimension("D", "supplier_number", "Supplier: Number"),
    json_dimension("D", "custom_fields", '$["supplier-category"].lookup.name',
                   "custom_fields:supplier-category.lookup.name", "Supplier: Tier (Custom)"),
]


def _prefixed(df: DataFrame, alias: str) -> DataFrame:
    """Every column renamed ``<alias>_<name>`` (one projection)."""
    return df.selectExpr(*[f"`{c}` AS `{alias}_{c}`" for c in df.columns])


def _coverage_base(
    t: APTables,
    start: str,
    end: str,
    ledger_period: DataFrame,
    with_supplier_info: bool = True,
    amounts: bool = False,
    rates_since: str | None = None,
    base: int = 1,
    match: str = "fanout",
) -> DataFrame:
    """Invoices in the window joined to supplier (inner), supplier info (left),
    ledger match counts and, for amounts, the month's rate.

    Columns are prefixed with their table alias: ``A_status``, ``B_name``, ...
    """
    a = t.invoice_header.where(in_window("payment_date", start, end, date_cast=True))
    a = _prefixed(a, "A")
    if amounts:
        r = monthly_rates(t.exchange_rate, base, rates_since).select(
            F.col("to_currency_id").alias("_ccy"), F.col("rate").alias("_rate"), F.col("rate_month").alias("_rm")
        )
        a = a.withColumn("_pm", month_start("A_payment_date"))
        a = join_dimension(a, r, [("A_currency_id", "_ccy"), ("_pm", "_rm")], "left", written=t.written)
        a = a.withColumn("_amount_usd", usd_expr("A_gross_total", "_rate", "divide", "one"))
    b = _prefixed(t.supplier_dim, "B")
    j = a.join(b, a.A_supplier_id == b.B_id, "inner")
    if with_supplier_info:
        d = _prefixed(t.supplier_information, "D")
        j = j.join(d, j.B_id == d.D_supplier_id, "left")
    return with_match_count(j, ledger_period, number="A_invoice_number", match=match)


def _order(sort_by: Sequence[str]) -> list[Column]:
    return [F.col(c).desc_nulls_first() for c in sort_by] + [F.col("variable_value").asc_nulls_last()]


DEFAULT_SORT = ("source_only_pct", "total_count")
AMOUNT_COLUMNS = {"both_total_usd_k", "source_only_total_usd_k", "total_usd_k"}
SORTABLE = {
    "both_count", "source_only_count", "total_count", "both_pct", "source_only_pct",
    "both_total_usd_k", "source_only_total_usd_k", "total_usd_k",
}


def _sort_keys(sort_by: Sequence[str] | str | None, amounts: bool) -> list[str]:
    """Validated sort keys: output columns only, amount columns only with amounts."""
    if sort_by is not None and not isinstance(sort_by, (str, list, tuple)):
        raise TypeError("sort_by is a column name or a list of them")
    keys = list(DEFAULT_SORT if sort_by is None else [sort_by] if isinstance(sort_by, str) else sort_by)
    allowed = SORTABLE if amounts else SORTABLE - AMOUNT_COLUMNS
    bad = [k for k in keys if k not in allowed]
    if bad:
        raise ValueError(f"cannot sort by {bad}")
    return keys


def coverage_by(
    t: APTables,
    dim: Dimension,
    start: str,
    end: str,
    ledger_period: DataFrame,
    top_n: int | None = 15,
    sort_by: Sequence[str] | str | None = None,
    amounts: bool = False,
    rates_since: str | None = None,
    with_supplier_info: bool = True,
    match: str = "fanout",
) -> DataFrame:
    """J31 (counts) / J32 (``amounts=True``): match coverage per value of one dimension.

    -> variable_value, both_count, source_only_count, total_count, [USD k x3],
    both_pct, source_only_pct, table_alias, variable_name, display_name.
    ``sort_by`` columns sort descending (ties: value ascending); ``top_n=None``
    keeps every value. Sort keys are checked against the output columns
    instead of being spliced into SQL text.
    """
    keys = _sort_keys(sort_by, amounts)
    base = _coverage_base(t, start, end, ledger_period, with_supplier_info, amounts, rates_since, match=match)
    cols = _coverage_columns()
    aggs = cols[:3] + (_amount_columns() if amounts else []) + cols[3:]
    out = base.groupBy(dim.value().alias("variable_value")).agg(*aggs)
    out = out.orderBy(*_order(keys))
    if top_n is not None:
        out = out.limit(top_n)
    return out.select(
        "*",
        F.lit(dim.table).alias("table_alias"),
        F.lit(dim.column).alias("variable_name"),
        F.lit(dim.display_name).alias("display_name"),
    )


def coverage_sweep(
    t: APTables,
    dims: Sequence[Dimension],
    start: str,
    end: str,
    ledger_period: DataFrame,
    top_n: int = 15,
    sort_by: Sequence[str] | str | None = "total_count",
    amounts: bool = False,
    rates_since: str | None = None,
    match: str = "fanout",
) -> DataFrame:
    """J31/J32 for many dimensions in one join and one aggregate.

    The reference runs one full join-and-aggregate per dimension (and again
    for amounts). Here the joined rows are built once, each row is expanded to
    one (dimension, value-as-text) pair per dimension, and a single
    ``groupBy(dimension, value)`` computes every table; ``row_number`` per
    dimension keeps the top ``top_n`` (planned with a partial group limit, so a
    dimension with many values is never gathered whole). A dimension whose
    column does not exist is logged and skipped instead of failing the sweep.
    """
    keys = _sort_keys(sort_by, amounts)
    base = _coverage_base(t, start, end, ledger_period, True, amounts, rates_since, match=match)
    present = set(base.columns)
    usable: list[tuple[int, Dimension]] = []
    for i, d in enumerate(dims):
        needed = f"{d.table}_{d.column}"
        if d.expr is None and needed not in present:
            log.warning("skipping dimension %s: no column %s", d.display_name, needed)
            continue
        usable.append((i, d))
    if not usable:
        raise ValueError("no usable dimension")
    return _ranked(_swept(base, usable, amounts), dims, top_n, keys)


def _swept(base: DataFrame, usable: Sequence[tuple[int, Dimension]], amounts: bool, count_invalid: bool = False) -> DataFrame:
    """One row per dimension and value with its counts; ``_invalid``, if asked for: those whose value could not be read."""
    pairs = F.expr("array(" + ", ".join(
        f"named_struct('dim_id', {i}, 'variable_value', CAST({d.sql()} AS STRING)"
        + (f", 'invalid', coalesce({d.invalid or 'false'}, false))" if count_invalid else ")")
        for i, d in usable
    ) + ")")
    keep = ["_k"] + (["_amount_usd"] if amounts else [])
    fields = ["_p.dim_id", "_p.variable_value"] + (["_p.invalid"] if count_invalid else [])
    long = base.select(*keep, F.explode(pairs).alias("_p")).select(*keep, *fields)
    cols = _coverage_columns()
    aggs = cols[:3] + (_amount_columns() if amounts else []) + cols[3:]
    if count_invalid:
        aggs.append(F.sum(F.when(F.col("invalid"), _all_rows()).otherwise(F.lit(0))).alias("_invalid"))
    return long.groupBy("dim_id", "variable_value").agg(*aggs)


def _ranked(g: DataFrame, dims: Sequence[Dimension], top_n: int, keys: Sequence[str]) -> DataFrame:
    """The first ``top_n`` values of each dimension, with its names."""
    w = Window.partitionBy("dim_id").orderBy(*_order(keys))
    top = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    meta = F.expr("array(" + ", ".join(
        f"named_struct('table_alias', {_q(d.table)}, 'variable_name', {_q(d.column)}, "
        f"'display_name', {_q(d.display_name)})"
        for d in dims
    ) + ")")
    # dimension metadata by position: a literal array lookup, no join
    info = F.element_at(meta, (F.col("dim_id") + 1).cast("int"))
    front = [info["table_alias"].alias("table_alias"), info["variable_name"].alias("variable_name"),
             info["display_name"].alias("display_name")]
    return top.select("dim_id", "rank", *front, *[c for c in top.columns if c not in ("dim_id", "rank")])


@dataclass(frozen=True)
class Sweep:
    """What :func:`isolated_sweep` found: the ranked values, and one row per dimension on how it went."""

    table: DataFrame
    report: DataFrame


def _condition(err: Exception) -> str:
    """The name of Spark's error condition, for a cause that has one."""
    named = re.search(r"\[([A-Z][A-Z0-9_.]+)\]", str(err))
    return named[1] if named else type(err).__name__


def _unreadable(base: DataFrame, d: Dimension) -> str | None:
    """Why a dimension's expressions do not fit the joined columns (Spark's analysis, no job), or None."""
    if d.expr is None and f"{d.table}_{d.column}" not in base.columns:
        return "UNRESOLVED_COLUMN"
    try:
        base.selectExpr(f"CAST({d.sql()} AS STRING)", f"CAST({d.invalid or 'false'} AS BOOLEAN)").schema  # noqa: B018
    except PySparkException as err:
        return _condition(err)
    return None


def isolated_sweep(
    t: APTables,
    dims: Sequence[Dimension],
    start: str,
    end: str,
    ledger_period: DataFrame,
    top_n: int = 15,
    sort_by: Sequence[str] | str | None = "total_count",
    amounts: bool = False,
    rates_since: str | None = None,
    match: str = "fanout",
) -> Sweep:
    """J33 where a failing dimension is reported and skipped, and the others come out whole.

    ``table`` is what :func:`coverage_sweep` returns for the dimensions that work. ``report`` has one row per
    dimension: dim_id, table_alias, variable_name, display_name, status, reason, value_count, invalid_count.

    * ``skipped``: the expression does not fit the columns (a missing column, a type or syntax error);
      known from Spark's analysis before any job runs.
    * ``failed``: a row raises while the expression is evaluated (a cast in ANSI mode, say).
    * ``ok``: all rows were evaluated; ``invalid_count`` of them, weighed like ``total_count``, had an input that
      could not be read and count as NULL (``Dimension.invalid``).

    ``reason`` is the name of Spark's error condition. The fused pass runs first and is written; only if it fails
    are the joined columns that the dimensions name written once and each dimension is tried by itself on them, then
    the fused pass is run over the rest. An error that no dimension causes is raised.
    """
    keys = _sort_keys(sort_by, amounts)
    base = _coverage_base(t, start, end, ledger_period, True, amounts, rates_since, match=match)
    notes: dict[int, tuple[str, str]] = {}
    for i, d in enumerate(dims):
        reason = _unreadable(base, d)
        if reason is not None:
            notes[i] = ("skipped", reason)
    usable = [(i, d) for i, d in enumerate(dims) if i not in notes]
    if usable:
        try:
            g = materialize(_swept(base, usable, amounts, count_invalid=True))
        except PySparkException as err:
            named = " ".join(f"{d.sql()} {d.invalid or ''}" for _, d in usable)
            keep = [c for c in base.columns if c in ("_k", "_amount_usd") or c in named]
            base = materialize(base.select(*keep))
            for i, d in usable:
                try:
                    base.selectExpr(f"CAST({d.sql()} AS STRING) AS v", f"{d.invalid or 'false'} AS w").agg(
                        F.count("v"), F.count_if("w")).collect()
                except PySparkException as own:
                    notes[i] = ("failed", _condition(own))
            if not any(i in notes for i, _ in usable):
                raise err
            usable = [(i, d) for i, d in usable if i not in notes]
            g = materialize(_swept(base, usable, amounts, count_invalid=True)) if usable else None
    if not usable:
        raise ValueError(f"no usable dimension: {notes}")
    for i, (status, reason) in notes.items():
        log.warning("dimension %s %s: %s", dims[i].display_name, status, reason)
    told = t.spark.createDataFrame(
        [(i, d.table, d.column, d.display_name, *notes.get(i, ("ok", None))) for i, d in enumerate(dims)],
        "dim_id int, table_alias string, variable_name string, display_name string, status string, reason string")
    counts = g.groupBy(F.col("dim_id").alias("_id")).agg(
        F.count(F.lit(1)).alias("value_count"), F.sum("_invalid").alias("invalid_count"))
    # an empty input has no values, but its dimensions were evaluated
    ok = F.col("status") == "ok"
    report = told.join(F.broadcast(counts), told.dim_id == counts._id, "left").select(
        *told.columns, *[F.when(ok, F.coalesce(c, F.lit(0))).alias(c) for c in ("value_count", "invalid_count")])
    return Sweep(_ranked(g.drop("_invalid"), dims, top_n, keys), report)
