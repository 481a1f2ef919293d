"""Exchange rates: latest observation per currency, per window or per month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apflow.functions.dates import in_window, month_start
from apflow.functions.measures import to_usd as usd_expr
from apflow.operators.joins import join_dimension


def _newest_first(ts: str) -> list[Column]:
    # The dialect sorts NULL as the largest value, so DESC puts NULL first;
    # ties on the timestamp are broken by the newest id to make it deterministic.
    return [F.col(ts).desc_nulls_first(), F.col("id").desc_nulls_first()]


def latest_rate_in_window(
    rates: DataFrame, base: int | None = 1, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Newest rate per target currency among observations in a date window.

    -> id, from_currency_id, to_currency_id, rate, created_at

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so each map task sends one row per currency however skewed the
    currencies are.
    """
    r = rates
    if base is not None:
        r = r.where(F.col("from_currency_id") == base)
    r = r.where(in_window("created_at", start, end, date_cast=True))
    w = Window.partitionBy("to_currency_id").orderBy(*_newest_first("created_at"))
    return (
        r.withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .select("id", "from_currency_id", "to_currency_id", "rate", "created_at")
    )


def monthly_rates(
    rates: DataFrame, base: int | None = 1, since: str | None = None, ts: str = "created_at"
) -> DataFrame:
    """Newest rate per target currency and calendar month of ``ts``.

    -> to_currency_id, rate, rate_month (DATE, first of month)

    With ``base=None`` every base currency competes in one month bucket, as in
    the variant keyed on ``rate_date`` (J03).
    """
    r = rates
    if base is not None:
        r = r.where(F.col("from_currency_id") == base)
    if since is not None:
        r = r.where(in_window(ts, since, None, date_cast=True))
    r = r.withColumn("rate_month", month_start(ts))
    w = Window.partitionBy("to_currency_id", "rate_month").orderBy(*_newest_first(ts))
    newest = r.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    keep = ["to_currency_id", "rate", "rate_month"] + ([ts] if ts != "created_at" else [])
    return newest.select(*keep)


def monthly_rates_by_rate_date(rates: DataFrame) -> DataFrame:
    """As J02 on ``rate_date``, no base filter and no lower bound.

    -> to_currency_id, rate, rate_date, rate_date_month
    """
    m = monthly_rates(rates, base=None, since=None, ts="rate_date")
    return m.select("to_currency_id", "rate", "rate_date", F.col("rate_month").alias("rate_date_month"))


def to_usd(
    invoices: DataFrame,
    rates: DataFrame,
    amount: str = "gross_total",
    by_month_of: str | None = "payment_date",
    direction: str = "divide",
    missing_rate: str = "one",
    out: str = "amount_usd",
) -> DataFrame:
    """Attach a rate to each invoice and convert ``amount`` to USD.

    ``rates`` is either J01 output (one rate per currency; ``by_month_of=None``)
    or J02 output (joined on currency and the month of ``by_month_of``). The
    join is a left join: an invoice without a rate keeps its row and gets the
    ``missing_rate`` policy. ``rate`` in the output is the raw joined rate.
    """
    r = rates.select(F.col("to_currency_id").alias("_ccy"), F.col("rate"), *(
        [F.col("rate_month").alias("_rm")] if by_month_of else []
    ))
    keys, inv = [("currency_id", "_ccy")], invoices
    if by_month_of:
        inv = inv.withColumn("_im", month_start(by_month_of))
        keys.append(("_im", "_rm"))
    joined = join_dimension(inv, r, keys, "left")
    joined = joined.withColumn(out, usd_expr(amount, "rate", direction, missing_rate))
    return joined.drop("_ccy", "_rm", "_im")
