"""Date helpers that pin down the reference's date semantics.

* ``day_diff`` counts calendar-day boundaries crossed (the dialect's
  ``DATEDIFF(day, a, b)``). Spark's 3-argument ``datediff`` counts whole
  24-hour units instead, so the 2-argument form on dates is used.
* ``month_start`` is a DATE (``trunc``), not the timestamp ``date_trunc`` gives.
* ``in_window`` keeps the two ``BETWEEN`` flavours apart: on a raw timestamp
  the upper bound is midnight of the last day; with ``date_cast`` the whole
  last day is inside.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_diff(start: Column | str, end: Column | str) -> Column:
    """Days from ``start`` to ``end`` by calendar date (``end - start``)."""
    return F.datediff(F.to_date(_col(end)), F.to_date(_col(start)))


def month_start(c: Column | str) -> Column:
    """First day of the month of ``c`` as a DATE."""
    return F.trunc(F.to_date(_col(c)), "month")


def month_label(c: Column | str) -> Column:
    """``'YYYY-MM'`` text of a date."""
    return F.date_format(_col(c), "yyyy-MM")


def in_window(c: Column | str, start: str | None, end: str | None, date_cast: bool = False) -> Column:
    """``c BETWEEN start AND end``; either bound may be ``None`` (open).

    Literals are passed as strings so Spark coerces them to the column's own
    type: a timestamp column compares against midnight, which is what the
    un-cast form means. ``date_cast=True`` compares ``DATE(c)`` instead. Both
    forms stay sargable: Catalyst pushes them into the parquet scan.
    """
    target = F.to_date(_col(c)) if date_cast else _col(c)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (target >= F.lit(start))
    if end is not None:
        cond = cond & (target <= F.lit(end))
    return cond
