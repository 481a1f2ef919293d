"""The invoice measure catalogue: USD conversion, terms, timeliness buckets.

Let ``usd = gross_total / coalesce(rate, 1)``. ``total_usd`` rounds ``usd``
per invoice before any sum and is a BIGINT so sums are exact. The two bucket
triples (on / after / before the due date; on time / late / early by more than
7 days) each add up to ``total_usd`` when both dates are present; a missing
payment date falls to 0 in all six.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from apflow.functions.dates import day_diff

# The payment-term code treated as "pay now" (callers add their own
# system's immediate-payment codes), and the +/- days that still count as on time.
DEFAULT_IMMEDIATE_TERMS = ("Due Upon Receipt",)
ON_TIME_TOLERANCE_DAYS = 7


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_usd(
    amount: Column | str,
    rate: Column | str,
    direction: str = "divide",
    missing_rate: str = "one",
) -> Column:
    """Convert ``amount`` with ``rate`` (DOUBLE arithmetic).

    ``direction``: ``'divide'`` (amount / rate) or ``'multiply'``.
    ``missing_rate``: ``'one'`` treats a NULL rate as 1, ``'null'`` leaves the
    result NULL so it drops out of sums.
    """
    r = _col(rate)
    if missing_rate == "one":
        r = F.coalesce(r, F.lit(1.0))
    elif missing_rate != "null":
        raise ValueError("missing_rate must be 'one' or 'null'")
    a = _col(amount).cast("double")
    if direction == "divide":
        return a / r
    if direction == "multiply":
        return a * r
    raise ValueError("direction must be 'divide' or 'multiply'")


def total_usd(usd: Column) -> Column:
    """Per-invoice USD rounded half away from zero, as BIGINT."""
    return F.round(usd, 0).cast("bigint")


def region_of(account_type_name: Column | str, region_map: Mapping[str, str]) -> Column:
    """Legal-entity name -> region; unmapped or NULL names give ``''``.

    The map (tens of entries) is a literal map inside the expression, so the
    lookup stays in generated code and needs no join.
    """
    if not region_map:
        return F.lit("")
    pairs = []
    for name, region in region_map.items():
        pairs += [F.lit(name), F.lit(region)]
    lookup = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(lookup, _col(account_type_name)), F.lit(""))


def payment_term_days(code: Column | str, immediate: Iterable[str] = DEFAULT_IMMEDIATE_TERMS) -> Column:
    """0 for immediate terms, else the number in the last two characters.

    Non-numeric endings give NULL, and three-digit terms lose their hundreds
    ("Net 120" -> 20) exactly as the reference's ``TRY_TO_NUMBER(RIGHT(x, 2))``.
    """
    c = _col(code)
    parsed = F.right(c, F.lit(2)).try_cast("decimal(38,0)").cast("bigint")
    return F.when(c.isin(list(immediate)), F.lit(0).cast("bigint")).otherwise(parsed)


def bucket_amounts(
    usd: Column, invoice_date: Column | str, net_due_date: Column | str, payment_date: Column | str
) -> dict[str, Column]:
    """The derived per-invoice measures, keyed by output column name."""
    inv, due, paid = _col(invoice_date), _col(net_due_date), _col(payment_date)
    amount = total_usd(usd)
    zero = F.lit(0).cast("bigint")
    late_by = day_diff(due, paid)
    tol = ON_TIME_TOLERANCE_DAYS
    return {
        "total_usd": amount,
        "wat": day_diff(inv, due) * usd,
        "wadtp": day_diff(inv, paid) * usd,
        "amount_paid_on_net_due_date": F.when(due == paid, amount).otherwise(zero),
        "amount_paid_after_net_due_date": F.when(due < paid, amount).otherwise(zero),
        "amount_paid_before_net_due_date": F.when(due > paid, amount).otherwise(zero),
        "amount_paid_on_time": F.when(late_by.between(-tol, tol), amount).otherwise(zero),
        "amount_paid_late": F.when(late_by > tol, amount).otherwise(zero),
        "amount_paid_7_plus_days_early": F.when(late_by < -tol, amount).otherwise(zero),
    }
