"""The four reports the reference specifies in prose (no code of its own).

Each returns the data behind the requested chart or table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apflow.functions.dates import day_diff, in_window, month_start

# The payment statuses the receivables report covers.
RECEIVABLE_STATUSES = ("Paid", "Overdue", "Pending")


def satisfaction_by_month(survey: DataFrame, start: str, end: str) -> DataFrame:
    """Average satisfaction score and responses per month of the window.

    -> survey_month, avg_csat, responses, customers
    """
    s = survey.where(in_window("survey_date", start, end, date_cast=True))
    return (
        s.groupBy(month_start("survey_date").alias("survey_month"))
        .agg(
            F.round(F.avg("csat_score"), 4).alias("avg_csat"),
            F.count(F.lit(1)).alias("responses"),
            F.count_distinct("customer_id").alias("customers"),
        )
        .orderBy("survey_month")
    )


def receivables_by_status(receivables: DataFrame, statuses: Sequence[str] = RECEIVABLE_STATUSES) -> DataFrame:
    """Total receivables, invoice and customer counts per payment status.

    -> payment_status, total_amount (DECIMAL, exact), invoice_count, customer_count
    """
    r = receivables.where(F.col("payment_status").isin(list(statuses)))
    return r.groupBy("payment_status").agg(
        F.sum(F.col("invoice_amount").cast("decimal(18,2)")).alias("total_amount"),
        F.count(F.lit(1)).alias("invoice_count"),
        F.count_distinct("customer_id").alias("customer_count"),
    )


def aging_outliers(aging: DataFrame, min_days: int = 90, top: int = 5) -> DataFrame:
    """Accounts more than ``min_days`` overdue, the ``top`` largest balances flagged.

    -> invoice_id, customer_name, days_overdue, outstanding_balance, is_top

    The top rows come from a bounded top-k (``TakeOrderedAndProject``, ties to
    the smaller invoice id) and are broadcast back as a flag, so no global
    window gathers the table into one partition.
    """
    over = aging.where(F.col("days_overdue") > min_days)
    top_ids = (
        over.orderBy(F.col("outstanding_balance").desc_nulls_last(), F.col("invoice_id").asc())
        .limit(top)
        .select(F.col("invoice_id").alias("_top_id"))
    )
    j = over.join(F.broadcast(top_ids), over.invoice_id == top_ids._top_id, "left")
    return j.select(
        "invoice_id",
        "customer_name",
        "days_overdue",
        "outstanding_balance",
        F.col("_top_id").isNotNull().alias("is_top"),
    )


def vendor_payment_timeliness(payments: DataFrame, start: str, end: str) -> DataFrame:
    """Per vendor, amount paid, share paid late and average days late.

    Late means paid after the net due date. -> vendor_name, paid_amount,
    invoice_count, late_count, late_share, avg_days_late (over late invoices)
    """
    p = payments.where(in_window("payment_date", start, end, date_cast=True))
    late_by = day_diff("net_due_date", "payment_date")
    is_late = late_by > 0
    late = F.count_if(is_late)
    return p.groupBy("vendor_name").agg(
        F.sum(F.col("paid_amount").cast("decimal(18,2)")).alias("paid_amount"),
        F.count(F.lit(1)).alias("invoice_count"),
        late.alias("late_count"),
        F.round(late.cast("double") / F.count(F.lit(1)), 4).alias("late_share"),
        F.round(F.avg(F.when(is_late, late_by)), 2).alias("avg_days_late"),
    )
