"""DuckDB SQL for the canonical AP tables (the same derivations as
``apflow.sources.fixtures``), used as CTE prefixes of the oracle queries.

The testdata tables (``orders``, ``customer``, ...) are views in the oracle
connection; these CTEs derive the AP tables from them.
"""

from __future__ import annotations

OD = "CAST(o_orderdate AS DATE)"

FIXTURES: dict[str, tuple[tuple[str, ...], str]] = {
    "invoice_header": ((), f"""
SELECT
  o_orderkey AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
       ELSE 'INV-' || CAST(o_custkey AS VARCHAR) || '-' || strftime({OD}, '%Y%m') END AS invoice_number,
  {OD} AS invoice_date,
  CAST({OD} + CAST([0, 30, 45, 60, 90, 120, -3][o_custkey % 7 + 1] AS INTEGER) AS DATE) AS net_due_date,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL
       ELSE CAST({OD} + CAST((o_orderkey * 37) % 110 - 4 AS INTEGER) AS DATE) END AS payment_date,
  CAST({OD} + CAST(o_orderkey % 5 AS INTEGER) AS DATE) AS date_received,
  CAST({OD} + CAST(o_orderkey % 3 AS INTEGER) AS DATE) AS created_at,
  CASE WHEN o_orderkey % 61 = 0 THEN -CAST(o_totalprice AS DECIMAL(18,2))
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS gross_total,
  CASE WHEN o_orderkey % 17 = 0 THEN CAST(0 AS DECIMAL(18,2))
       ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount_due,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE o_orderkey % 25 END AS currency_id,
  CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE o_custkey END AS supplier_id,
  o_custkey % 7 AS payment_term_id,
  o_custkey % 22 AS account_type_id,
  CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'cxml'
       WHEN o_orderkey % 9 = 0 THEN 'api' ELSE 'email' END AS channel,
  CASE WHEN o_orderkey % 47 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'Voided' ELSE 'APPROVED' END AS status,
  CASE WHEN o_orderkey % 19 = 0 THEN 'Credit Note' ELSE 'Invoice' END AS document_type,
  o_orderstatus <> 'O' AS paid,
  o_orderpriority AS payment_channel,
  o_custkey % 40 AS created_by_id,
  o_custkey % 33 AS requested_by_id
FROM orders"""),
    "invoice_line": ((), """
SELECT l_orderkey AS invoice_header_id, CAST(l_linenumber AS BIGINT) AS line_num, l_partkey AS order_line_id,
       (l_orderkey + l_linenumber) % 25 AS currency_id, CAST(l_shipdate AS DATE) AS created_at,
       l_returnflag AS status, l_linestatus AS type
FROM lineitem"""),
    "order_line": ((), "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS order_header_id FROM part"),
    "order_header": ((), """
SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE 'PO-' || CAST(id AS VARCHAR) END AS po_number
FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS id FROM part)"""),
    "exchange_rate": ((), f"""
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 10 = 9 THEN 2 ELSE 1 END AS BIGINT) AS from_currency_id,
       (o_orderkey * 7) % 23 AS to_currency_id, 0.5 + o_totalprice / 100000.0 AS rate,
       {OD} AS created_at, CAST({OD} + CAST(o_orderkey % 9 AS INTEGER) AS DATE) AS rate_date
FROM orders"""),
    "currency": ((), """
SELECT CAST(n_nationkey AS BIGINT) AS id, 'C' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation"""),
    "payment_term": ((), """
SELECT CAST(n_nationkey AS BIGINT) AS id,
       ['Due Upon Receipt', 'Net 30', 'Net 45', 'Net 60', 'Net 90', 'Net 120', 'Custom'][n_nationkey + 1] AS code,
       CAST([0, 30, 45, 60, 90, 120, NULL][n_nationkey + 1] AS BIGINT) AS days_for_net_payment
FROM nation WHERE n_nationkey < 7"""),
    "account_type": ((), """
SELECT CAST(n_nationkey AS BIGINT) AS id, 'Entity ' || CAST(n_nationkey AS VARCHAR) AS name
FROM nation WHERE n_nationkey < 21"""),
    "country": ((), "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation"),
    "supplier_dim": ((), """
SELECT c_custkey AS id, c_name AS name, 'S' || CAST(c_custkey AS VARCHAR) AS number,
       c_custkey % 7 AS payment_term_id,
       CASE WHEN c_nationkey % 6 = 5 THEN NULL ELSE CAST(c_nationkey % 6 AS BIGINT) END AS shipping_term_id,
       c_mktsegment AS po_method, c_acctbal > 0 AS send_invoices_to_approvals,
       CASE WHEN c_custkey % 5 = 0 THEN '{}'
            ELSE '{"supplier-tier":{"name":"Tier ' || CAST(c_custkey % 3 + 1 AS VARCHAR)
                 || '"},"other":{"code":' || CAST(c_custkey % 7 AS VARCHAR) || '}}' END AS custom_fields
FROM customer"""),
    "supplier_information": ((), """
SELECT c_custkey + 1 AS id, c_custkey AS supplier_id, c_name AS name,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'T' || CAST(c_custkey AS VARCHAR) END AS federal_tax_num,
       'N' || CAST(c_custkey % 50 AS VARCHAR) AS supplier_number,
       '{"supplier-category":{"lookup":{"name":"Cat ' || CAST(c_custkey % 4 AS VARCHAR) || '"}}}' AS custom_fields
FROM customer WHERE c_custkey % 10 <> 3"""),
    "supplier_address": ((), """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS country_id FROM customer
UNION ALL
SELECT c_custkey AS id, CAST((c_nationkey + 1) % 25 AS BIGINT) AS country_id FROM customer WHERE c_custkey % 8 = 0"""),
    "ledger_backup": (("invoice_header",), """
SELECT h.invoice_number AS invoice__, c.c_name AS supplier, 'S' || CAST(c.c_custkey AS VARCHAR) AS supplier__,
       h.payment_date, h.created_by_id AS requester, h.gross_total AS total_usd, h.invoice_date,
       CAST(h.invoice_date + CAST(k.k AS INTEGER) AS DATE) AS created_date,
       h.date_received AS invoice_received_date, h.net_due_date
FROM invoice_header h
JOIN customer c ON h.supplier_id = c.c_custkey
JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k ON k.k = 0 OR h.id % 29 = 0
WHERE h.supplier_id % 13 <> 0 AND h.id % 7 <> 0"""),
    "ledger": (("ledger_backup",), """
SELECT invoice__, supplier, supplier__, payment_date, requester, total_usd, invoice_date, created_date,
       invoice_received_date, net_due_date
FROM (
  SELECT *, ROW_NUMBER() OVER (
    PARTITION BY invoice__, supplier, payment_date, requester, total_usd, invoice_date
    ORDER BY created_date DESC NULLS FIRST, invoice_received_date DESC NULLS FIRST,
             net_due_date DESC NULLS FIRST, supplier__ ASC NULLS LAST) AS rn
  FROM ledger_backup)
WHERE rn = 1"""),
    "receivables": ((), """
SELECT o_orderkey AS invoice_id, o_custkey AS customer_id, o_totalprice AS invoice_amount,
       CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Overdue' END AS payment_status
FROM orders"""),
    "survey": ((), f"""
SELECT o_orderkey AS survey_id, {OD} AS survey_date, o_custkey AS customer_id, 1 + o_orderkey % 5 AS csat_score
FROM orders"""),
    "vendor_payments": (("invoice_header",), """
SELECT h.id AS invoice_id, h.payment_date, h.invoice_date, h.net_due_date, c.c_name AS vendor_name,
       h.gross_total AS paid_amount
FROM invoice_header h LEFT JOIN customer c ON h.supplier_id = c.c_custkey"""),
}


def aging_sql(as_of: str) -> str:
    return f"""
SELECT h.id AS invoice_id, h.supplier_id AS customer_id, c.c_name AS customer_name,
       date_diff('day', h.net_due_date, DATE '{as_of}') AS days_overdue, h.amount_due AS outstanding_balance
FROM invoice_header h LEFT JOIN customer c ON h.supplier_id = c.c_custkey
WHERE NOT h.paid"""


def _resolve(names: list[str], extra: dict[str, tuple[tuple[str, ...], str]]) -> list[str]:
    table = {**FIXTURES, **extra}
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in table[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_fixtures(
    names: list[str], ctes: list[tuple[str, str]], select: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None
) -> str:
    """``WITH <fixtures>, <ctes> <select>``; fixture dependencies are added in order."""
    extra = extra or {}
    table = {**FIXTURES, **extra}
    parts = [f"{n} AS ({table[n][1]}\n)" for n in _resolve(names, extra)]
    parts += [f"{n} AS ({body}\n)" for n, body in ctes]
    if not parts:
        return select
    return "WITH " + ",\n".join(parts) + "\n" + select
