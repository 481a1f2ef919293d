"""Pure Column -> Column helpers (no DataFrames, no actions)."""

from apflow.functions.dates import day_diff, in_window, month_label, month_start
from apflow.functions.measures import (
    bucket_amounts,
    payment_term_days,
    region_of,
    to_usd,
    total_usd,
)

__all__ = [
    "bucket_amounts",
    "day_diff",
    "in_window",
    "month_label",
    "month_start",
    "payment_term_days",
    "region_of",
    "to_usd",
    "total_usd",
]
