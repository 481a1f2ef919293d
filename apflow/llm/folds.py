"""The fixed fold of the supervised operators: one document in five is held out by the CRC-32 of its id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """True where the remainder is 0; a null id is in neither fold (false here, and not learned from)."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def learned_from(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != 0, F.lit(False))
