"""Lookup subgraphs joined onto invoices: PO numbers, supplier country, currency code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apflow.functions.dates import in_window


def po_numbers(lines: DataFrame, order_lines: DataFrame, order_headers: DataFrame) -> DataFrame:
    """Per invoice header, its distinct PO numbers sorted and joined by ', '.

    -> invoice_header_id, po_number. Headers whose lines carry no PO are absent.

    The reference left-joins lines -> order lines -> order headers and then
    filters ``po_number IS NOT NULL``, which makes both joins inner. The two
    small sides are joined first (order line -> PO), so the big line table
    meets an already filtered, two-column lookup. The string is built from a
    ``collect_set`` per header: its size is bounded by the header's own lines.
    """
    po = order_headers.where(F.col("po_number").isNotNull()).select(
        F.col("id").alias("_oh_id"), "po_number"
    )
    ol_po = order_lines.join(po, order_lines.order_header_id == po._oh_id, "inner").select(
        F.col("id").alias("_ol_id"), "po_number"
    )
    li = lines.select("invoice_header_id", "order_line_id")
    joined = li.join(ol_po, li.order_line_id == ol_po._ol_id, "inner")
    return joined.groupBy("invoice_header_id").agg(
        F.array_join(F.array_sort(F.collect_set("po_number")), ", ").alias("po_number")
    )


def supplier_country(addresses: DataFrame, countries: DataFrame) -> DataFrame:
    """One country name per supplier address id.

    -> id, country. The reference orders by the partition key itself, so the
    survivor is arbitrary; here the smallest country id wins.
    """
    c = countries.select(F.col("id").alias("_cid"), F.col("name").alias("country"))
    a = addresses.join(c, addresses.country_id == c._cid, "left")
    w = Window.partitionBy("id").orderBy(F.col("country_id").asc_nulls_last())
    return a.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("id", "country")


def currency_codes(headers: DataFrame, currencies: DataFrame, paid_after: str | None) -> DataFrame:
    """Each invoice's currency id with its code (left lookup).

    -> currency_id, code
    """
    h = headers if paid_after is None else headers.where(F.col("payment_date") > F.lit(paid_after))
    cur = currencies.select(F.col("id").alias("_cur_id"), "code")
    return h.join(cur, h.currency_id == cur._cur_id, "left").select("currency_id", "code")
