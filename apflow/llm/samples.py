"""Bounded deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows of least hash of the columns ``by`` (all rows, if fewer).

    Rows above twice the share asked for are left out first, so what the tasks send on for the final order
    is about 2 n rows in all, however many tasks there are. Where many rows share their hash, the sample may be smaller.
    """
    h, total = F.xxhash64(*by), df.count()
    if total > 2 * n:
        df = df.where(F.shiftrightunsigned(h, 1) <= F.lit(int(2 * n / total * 2**63)))
    return df.orderBy(h, *by).limit(n)


def least_hashed_distinct(df: DataFrame, n: int, about: int, *by: str) -> DataFrame:
    """One row each of the ``n`` least hashed distinct values of the columns ``by`` (of all, if fewer).

    ``about`` estimates the number of distinct values. All copies of a value share its hash, so values above twice
    the share asked for are left out before copies are dropped. The other columns must follow from ``by``.
    """
    h = F.xxhash64(*by)
    if about > 2 * n:
        df = df.where(F.shiftrightunsigned(h, 1) <= F.lit(int(2 * n / about * 2**63)))
    return df.dropDuplicates(list(by)).orderBy(h, *by).limit(n)
