"""DuckDB oracle SQL per registered query.

Each job is stated as set logic over the fixture tables: ``DISTINCT ON`` picks, semi and anti
joins, counts of matching ledger rows as weights, one definition per measure. Shared pieces
are small functions that return SQL.
"""

from __future__ import annotations

from oracles import params as P
from oracles.fixtures import FIXTURES, aging_sql, with_fixtures

PERIOD = f"BETWEEN DATE '{P.START}' AND DATE '{P.END}'"
NEWEST = "created_at DESC NULLS FIRST, id DESC NULLS FIRST"
LARGEST = "gross_total DESC NULLS FIRST, id ASC NULLS LAST"


def month(day: str) -> str:
    return f"CAST(date_trunc('month', {day}) AS DATE)"


def pick(table: str, key: str, order: str, out: str, where: str = "TRUE") -> str:
    """The first row of each ``key`` in ``order``."""
    return f"SELECT DISTINCT ON ({key}) {out} FROM {table} WHERE {where} ORDER BY {key}, {order}"


# ---------------------------------------------------------------------- rates
def period_rates() -> str:
    return pick("exchange_rate", "to_currency_id", NEWEST, "id, from_currency_id, to_currency_id, rate, created_at",
                f"from_currency_id = {P.BASE_CURRENCY} AND CAST(created_at AS DATE) {PERIOD}")


def rates_per_month() -> str:
    m = month("CAST(created_at AS DATE)")
    return pick("exchange_rate", f"to_currency_id, {m}", NEWEST, f"to_currency_id, rate, {m} AS rate_month",
                f"from_currency_id = {P.BASE_CURRENCY} AND CAST(created_at AS DATE) >= DATE '{P.RATES_SINCE}'")


def rates_per_rate_month() -> str:
    m = month("rate_date")
    return pick("exchange_rate", f"to_currency_id, {m}", "rate_date DESC NULLS FIRST, id DESC NULLS FIRST",
                f"to_currency_id, rate, rate_date, {m} AS rate_date_month")


def j01() -> str:
    return with_fixtures(["exchange_rate"], [], period_rates())


def j02() -> str:
    return with_fixtures(["exchange_rate"], [], rates_per_month())


def j03() -> str:
    return with_fixtures(["exchange_rate"], [], rates_per_rate_month())


def j04() -> str:
    return with_fixtures(["invoice_header", "exchange_rate"], [("monthly", rates_per_month())], f"""
SELECT id, currency_id, payment_date, gross_total, rate, CAST(gross_total AS DOUBLE) / ifnull(rate, 1) AS amount_usd
FROM invoice_header LEFT JOIN monthly ON (to_currency_id, rate_month) = (currency_id, {month('payment_date')})""")


def j04_window() -> str:
    return with_fixtures(["invoice_header", "exchange_rate"], [("period_rate", period_rates())], """
SELECT h.id, currency_id, payment_date, gross_total, rate, CAST(gross_total AS DOUBLE) * rate AS amount_usd
FROM invoice_header h LEFT JOIN period_rate ON to_currency_id = currency_id""")


# ------------------------------------------------------------------- invoices
def accepted(strict: bool, currency: bool = True, h: str = "") -> str:
    """The conditions on a header, columns prefixed with ``h``."""
    rules = [f"{h}payment_date {PERIOD}", f"{h}status <> 'Voided'", f"{h}gross_total >= 0"]
    if currency:
        rules.append(f"{h}currency_id <> {P.EXCLUDED_CURRENCY}")
    if strict:
        # due and paid within a year of the invoice, never before it
        rules += [f"{h}{d} - {h}invoice_date BETWEEN 0 AND 365" for d in ("net_due_date", "payment_date")]
    return " AND ".join(rules)


def one_per_number(where: str, out: str = "*") -> str:
    return pick("invoice_header", "invoice_number", LARGEST, out, where)


def j05() -> str:
    return with_fixtures(["invoice_header"], [],
                         one_per_number(accepted(False), "id, invoice_number, gross_total, payment_date, supplier_id"))


def j06() -> str:
    return with_fixtures(["invoice_header"], [], "SELECT id, invoice_number, payment_date, gross_total, currency_id "
                         f"FROM invoice_header WHERE {accepted(True)}")


def _by_line_currency() -> str:
    lines = "(invoice_header h LEFT JOIN (SELECT invoice_header_id, line_num, currency_id AS line_currency FROM invoice_line) ON invoice_header_id = h.id)"
    return pick(lines, "h.invoice_number", "h.gross_total DESC NULLS FIRST, h.id ASC NULLS LAST, line_num ASC NULLS LAST",
                "h.invoice_number, h.payment_date, h.gross_total, line_currency AS currency_id", accepted(True, False, "h."))


def j07() -> str:
    return with_fixtures(["invoice_header", "invoice_line"], [], _by_line_currency())


def j08() -> str:
    return with_fixtures(["invoice_header"], [("chosen", one_per_number(accepted(True)))],
                         "SELECT id, invoice_number, supplier_id FROM chosen WHERE supplier_id IS NOT NULL")


def j09() -> str:
    return with_fixtures(["invoice_header", "invoice_line", "exchange_rate"],
                         [("period_rate", period_rates()), ("chosen", _by_line_currency())], """
SELECT count(DISTINCT invoice_number) AS unique_invoice_numbers, count(*) AS total_invoices,
       round(sum(CAST(gross_total AS DOUBLE) / rate), 0) AS amount_due_usd
FROM chosen LEFT JOIN period_rate ON to_currency_id = currency_id""")


def j10() -> str:
    return with_fixtures(["invoice_header", "exchange_rate"],
                         [("period_rate", period_rates()), ("chosen", one_per_number(accepted(True)))], """
SELECT CAST(payment_date AS DATE) AS payment_day, count(DISTINCT invoice_number) AS unique_invoice_numbers,
       count(*) AS total_invoices, round(sum(CAST(gross_total AS DOUBLE) / ifnull(rate, 1)), 0) / 1000000 AS amount_due_usd
FROM chosen LEFT JOIN period_rate ON to_currency_id = currency_id GROUP BY ALL""")


# ----------------------------------------------------- matches with the ledger
# ledger rows per number: a header weighs as many rows as it matches, an unmatched one weighs one
LEDGER_HITS = ("hits", "SELECT invoice__ AS hit_number, count(*) AS k FROM ledger WHERE invoice__ IS NOT NULL GROUP BY ALL")
PERIOD_HITS = ("hits", f"SELECT invoice__ AS hit_number, count(*) AS k FROM ledger WHERE payment_date {PERIOD} AND invoice__ IS NOT NULL GROUP BY ALL")
WEIGHT = "ifnull(k, 1)"
SUPPLIER_COVERAGE = ("coverage", f"""
SELECT supplier_id, count(*) FILTER (k IS NULL) AS only_in_source, CAST(ifnull(sum(k), 0) AS BIGINT) AS present_in_both,
       CAST(sum({WEIGHT}) AS BIGINT) AS total_invoices,
       CAST(count(*) FILTER (k IS NULL) AS DOUBLE) * 100.0 / sum({WEIGHT}) AS pct_only_in_source
FROM invoice_header LEFT JOIN hits ON hit_number = invoice_number
WHERE payment_date {PERIOD} AND supplier_id IN (SELECT id FROM supplier_dim) GROUP BY supplier_id""")
PROBLEM_SUPPLIERS = ("problem", f"""
SELECT supplier_id FROM coverage WHERE pct_only_in_source > {P.MIN_PCT_MISSING}
ORDER BY total_invoices DESC NULLS FIRST, supplier_id ASC NULLS LAST LIMIT {P.TOP_PROBLEM_SUPPLIERS}""")
COVERAGE = [LEDGER_HITS, SUPPLIER_COVERAGE]


def j20() -> str:
    return with_fixtures(["invoice_header", "ledger", "supplier_dim"], COVERAGE, "FROM coverage")


def j21() -> str:
    return with_fixtures(["invoice_header", "ledger", "supplier_dim"], [*COVERAGE, PROBLEM_SUPPLIERS], "FROM problem")


def j22() -> str:
    return with_fixtures(["invoice_header", "ledger", "supplier_dim", "exchange_rate"], [
        ("by_rate_month", rates_per_rate_month()),
        ("unmatched", f"""
SELECT * FROM invoice_header h WHERE payment_date {PERIOD}
AND NOT EXISTS (FROM ledger WHERE invoice__ = h.invoice_number)"""),
    ], f"""
SELECT u.invoice_number, s.name, rate * CAST(u.gross_total AS DOUBLE) AS gross_total_usd, CAST(u.payment_date AS DATE) AS payment_date
FROM unmatched u LEFT JOIN supplier_dim s ON s.id = u.supplier_id
LEFT JOIN by_rate_month ON (to_currency_id, rate_date_month) = (u.currency_id, {month('u.payment_date')})""")


# ------------------------------------------------------------- enriched facts
# days from due date to payment that each amount counts
SLIP_BANDS = {
    "amount_paid_on_net_due_date": "slip = 0", "amount_paid_after_net_due_date": "slip > 0",
    "amount_paid_before_net_due_date": "slip < 0", "amount_paid_on_time": "abs(slip) <= 7",
    "amount_paid_late": "slip > 7", "amount_paid_7_plus_days_early": "slip < -7",
}
REGIONS = {"AMER": range(0, 3), "EMEA": range(3, 12), "APAC": range(12, 18), "LATAM": range(18, 20)}


def _measured(source: str, out: str) -> str:
    regions = ", ".join(f"'Entity {i}': '{name}'" for name, ids in REGIONS.items() for i in ids)
    bands = ", ".join(f"if({test}, total_usd, 0) AS {name}" for name, test in SLIP_BANDS.items())
    return f"""
SELECT {out}, ifnull(MAP {{{regions}}}[account_type_name], '') AS region,
       if(payment_terms = 'Due Upon Receipt', 0, CAST(TRY_CAST(right(payment_terms, 2) AS DECIMAL(38,0)) AS BIGINT)) AS payment_term_days,
       total_usd, (net_due_date - invoice_date) * usd AS wat, (payment_date - invoice_date) * usd AS wadtp, {bands}
FROM (SELECT *, CAST(round(usd, 0) AS BIGINT) AS total_usd, payment_date - net_due_date AS slip
      FROM (SELECT *, CAST(gross_total AS DOUBLE) / rate AS usd FROM {source}))
WHERE invoice_number IS NOT NULL"""


FIRST_COUNTRY = ("home", """
SELECT DISTINCT ON (a.id) a.id, country.name AS country FROM supplier_address a LEFT JOIN country ON country.id = a.country_id
ORDER BY a.id, a.country_id ASC NULLS LAST""")
HEADER_ORDERS = ("orders_of", """
SELECT invoice_header_id, array_to_string(list_sort(list(DISTINCT po_number)), ', ') AS po_number
FROM invoice_line
JOIN (SELECT o.id AS line, po_number FROM order_line o JOIN order_header h ON h.id = o.order_header_id WHERE po_number IS NOT NULL)
  ON line = order_line_id
GROUP BY ALL""")
ENRICHED = ["invoice_header", "invoice_line", "order_line", "order_header", "exchange_rate", "currency",
            "payment_term", "account_type", "country", "supplier_information", "supplier_address"]


def _monthly_fact(excluded: str) -> list[tuple[str, str]]:
    """Loose rules, monthly rates, all lookups."""
    return [
        ("quote", rates_per_month()),
        ("chosen", one_per_number(f"{accepted(False)} AND supplier_id NOT IN ({excluded})")),
        *_with_all_lookups(f"(to_currency_id, rate_month) = (i.currency_id, {month('i.payment_date')})"),
    ]


def _period_fact_all_lookups() -> list[tuple[str, str]]:
    """Strict rules, one rate per currency, a supplier required, all lookups."""
    return [
        ("quote", period_rates()), ("every", one_per_number(accepted(True))),
        ("chosen", "FROM every WHERE supplier_id IS NOT NULL"), *_with_all_lookups("to_currency_id = i.currency_id"),
    ]


def _with_all_lookups(quoted: str) -> list[tuple[str, str]]:
    """The ``chosen`` headers with every lookup and the rate of ``quote`` where ``quoted`` holds."""
    return [
        FIRST_COUNTRY, HEADER_ORDERS,
        ("looked_up", f"""
SELECT i.* EXCLUDE (created_at), i.date_received AS invoice_received_date, i.created_at AS created_date,
       ifnull(quote.rate, 1) AS rate, currency.code AS code, si.name AS vendor_name, home.country AS country,
       terms.code AS payment_terms, kind.name AS account_type_name, orders_of.po_number AS po_number
FROM chosen i
LEFT JOIN quote ON {quoted}
LEFT JOIN currency ON currency.id = i.currency_id
LEFT JOIN supplier_information si ON si.id = i.supplier_id
LEFT JOIN home ON home.id = i.supplier_id
LEFT JOIN payment_term terms ON terms.id = i.payment_term_id
LEFT JOIN account_type kind ON kind.id = i.account_type_id
LEFT JOIN orders_of ON invoice_header_id = i.id"""),
        ("fact", _measured("looked_up", """payment_date, invoice_number, po_number, gross_total, invoice_date, net_due_date,
       invoice_received_date, created_date, channel, rate, code, vendor_name, country, payment_terms, account_type_name""")),
    ]


def _period_fact(require_supplier: bool) -> list[tuple[str, str]]:
    """Strict rules, one rate per currency, basic lookups."""
    return [
        ("period_rate", period_rates()), ("every", one_per_number(accepted(True))),
        ("chosen", "FROM every" + (" WHERE supplier_id IS NOT NULL" if require_supplier else "")),
        ("looked_up", """
SELECT i.* EXCLUDE (created_at, supplier_id), i.date_received AS invoice_received_date, i.created_at AS created_date,
       ifnull(period_rate.rate, 1) AS rate, currency.code AS code, si.id AS supplier_id, terms.code AS payment_terms,
       kind.name AS account_type_name
FROM chosen i
LEFT JOIN period_rate ON to_currency_id = i.currency_id
LEFT JOIN currency ON currency.id = i.currency_id
LEFT JOIN supplier_information si ON si.id = i.supplier_id
LEFT JOIN payment_term terms ON terms.id = i.payment_term_id
LEFT JOIN account_type kind ON kind.id = i.account_type_id"""),
        ("fact", _measured("looked_up", """payment_date, invoice_number, gross_total, invoice_date, net_due_date,
       invoice_received_date, created_date, rate, code, supplier_id, payment_terms, account_type_name""")),
    ]


BY_MONTH = """
SELECT strftime(payment_date, '%Y-%m') AS payment_month, count(*) AS invoice_count,
       round(sum(total_usd) / 1000000, 2) AS amount_due_usd_millions,
       round(sum(wat) / nullif(sum(total_usd), 0), 1) AS wat_days, round(sum(wadtp) / nullif(sum(total_usd), 0), 1) AS wadtp_days
FROM fact WHERE payment_date IS NOT NULL AND channel NOT IN ('api', 'cxml') GROUP BY ALL"""
WITH_PROBLEMS = [*COVERAGE, PROBLEM_SUPPLIERS, *_monthly_fact("FROM problem")]


def j11() -> str:
    return with_fixtures(ENRICHED, _period_fact(False), "FROM fact")


def j11_all_lookups() -> str:
    return with_fixtures(ENRICHED, _period_fact_all_lookups(), "FROM fact WHERE invoice_number IS NOT NULL")


def j12() -> str:
    return with_fixtures([*ENRICHED, "ledger", "supplier_dim"], WITH_PROBLEMS, "FROM fact")


def j13(require_supplier: bool) -> str:
    return with_fixtures(ENRICHED, _period_fact(require_supplier), "SELECT sum(total_usd) / 1000000 AS amount_due_usd_millions FROM fact")


def j14() -> str:
    return with_fixtures(ENRICHED, _monthly_fact(", ".join(map(str, P.EXCLUDED_SUPPLIERS))), BY_MONTH)


def j15() -> str:
    return with_fixtures([*ENRICHED, "ledger", "supplier_dim"], WITH_PROBLEMS, BY_MONTH)


def j16() -> str:
    return with_fixtures(["invoice_line", "order_line", "order_header"], [HEADER_ORDERS], "FROM orders_of")


def j17() -> str:
    return with_fixtures(["supplier_address", "country"], [FIRST_COUNTRY], "FROM home")


def j18() -> str:
    # every line meets every rate of its currency from the base
    return with_fixtures(["invoice_header", "invoice_line", "exchange_rate"], [
        ("quotes", f"SELECT to_currency_id AS currency_id, CAST(rate AS DECIMAL(18,8)) AS quote FROM exchange_rate WHERE from_currency_id = {P.BASE_CURRENCY}"),
        ("quoted", "SELECT invoice_header_id AS id, quote FROM invoice_line JOIN quotes USING (currency_id)"),
    ], f"""
SELECT count(DISTINCT invoice_number) AS unique_invoice_numbers, count(*) AS total_invoices,
       CAST(sum(amount_due * quote) AS DECIMAL(38,2)) AS amount_due_usd
FROM quoted JOIN invoice_header USING (id) WHERE payment_date > DATE '{P.PAID_AFTER}'""")


def j19() -> str:
    return with_fixtures(["invoice_header", "payment_term", "exchange_rate"], [("weighed", """
SELECT CAST(amount_due AS DOUBLE) * ifnull(rate, 1) AS weight, ifnull(CAST(days_for_net_payment AS DOUBLE), 0) AS days
FROM (SELECT * FROM invoice_header WHERE amount_due > 0 AND status = 'APPROVED') h
LEFT JOIN exchange_rate ON to_currency_id = h.currency_id LEFT JOIN payment_term t ON t.id = h.payment_term_id""")],
                         "SELECT round(sum(weight * days) / nullif(sum(weight), 0), 6) AS wat FROM weighed")


# --------------------------------------------------------------------- ledger
def j23() -> str:
    return with_fixtures(["ledger"], [], "FROM ledger")


def j23_control_totals() -> str:
    return with_fixtures(["ledger"], [("sided", """
SELECT strftime(payment_date, '%Y-%m') AS payment_month, total_usd, TRUE AS old FROM ledger_backup
UNION ALL SELECT strftime(payment_date, '%Y-%m'), total_usd, FALSE FROM ledger""")], """
SELECT payment_month, count(*) FILTER (old) AS rows_before, count(*) FILTER (NOT old) AS rows_after,
       count(*) FILTER (old) - count(*) FILTER (NOT old) AS rows_removed,
       CAST(sum(total_usd) FILTER (old) AS DECIMAL(38,2)) AS total_before,
       CAST(sum(total_usd) FILTER (NOT old) AS DECIMAL(38,2)) AS total_after
FROM sided GROUP BY ALL""")


def _repeated(keys: str) -> str:
    """All ledger rows of numbers that some key combination has more than once (before the repair)."""
    return with_fixtures(["ledger_backup"], [], f"""
SELECT * FROM ledger_backup WHERE invoice__ IN (
  SELECT invoice__ FROM ledger_backup WHERE payment_date > DATE '{P.LEDGER_AFTER}' GROUP BY {keys} HAVING count(*) > 1)""")


def j24() -> str:
    return _repeated("invoice__, supplier")


def j25() -> str:
    return _repeated("invoice__, supplier, total_usd")


LEDGER_COLS = ("invoice__, supplier, supplier__, payment_date, requester, total_usd, invoice_date, created_date, "
               "invoice_received_date, net_due_date")
ONE_ENTRY = ("entry", pick(
    "ledger", "invoice__, supplier, total_usd",
    ", ".join(f"{c} ASC NULLS LAST" for c in ("supplier__", "payment_date", "requester", "invoice_date", "created_date",
                                              "invoice_received_date", "net_due_date")),
    LEDGER_COLS, f"payment_date > DATE '{P.LEDGER_AFTER}'"))


def j26() -> str:
    return with_fixtures(["ledger"], [ONE_ENTRY], "FROM entry")


def j27() -> str:
    return with_fixtures(["invoice_header", "ledger", "supplier_dim", "currency", "exchange_rate"], [
        ("monthly", rates_per_month()), ONE_ENTRY,
        ("chosen", one_per_number(f"payment_date {PERIOD} AND document_type = 'Invoice' AND status <> 'Voided'")),
    ], f"""
SELECT h.invoice_number AS source_invoice_number, currency.code AS source_currency_code, s.name AS source_vendor_name,
       s.number AS source_supplier_number, CAST(h.payment_date AS DATE) AS source_payment_date,
       round(CAST(h.gross_total AS DOUBLE) / ifnull(rate, 1), 2) AS source_total_usd,
       e.invoice__ AS ledger_invoice_number, e.supplier AS ledger_vendor_name, e.supplier__ AS ledger_supplier_number,
       e.payment_date AS ledger_payment_date, e.total_usd AS ledger_total_usd
FROM chosen h
LEFT JOIN currency ON currency.id = h.currency_id
LEFT JOIN supplier_dim s ON s.id = h.supplier_id
LEFT JOIN monthly ON (to_currency_id, rate_month) = (h.currency_id, {month('h.payment_date')})
LEFT JOIN entry e ON e.invoice__ = h.invoice_number""")


# ------------------------------------------------------------- missing rates
def _missing(by: str) -> list[tuple[str, str]]:
    return [LEDGER_HITS, ("tally", f"""
SELECT {by}, CAST(sum({WEIGHT}) AS BIGINT) AS total_invoices,
       count(*) FILTER (k IS NULL AND invoice_number IS NOT NULL) AS missing_invoices
FROM invoice_header LEFT JOIN hits ON hit_number = invoice_number
WHERE paid AND CAST(payment_date AS DATE) {PERIOD} GROUP BY {by} HAVING sum({WEIGHT}) >= {P.MIN_INVOICES}"""), ("rated", f"""
SELECT {by}, total_invoices, missing_invoices, total_invoices - missing_invoices AS matched_invoices,
       round(missing_invoices * 100.0::DOUBLE / total_invoices, 2) AS missing_rate_pct,
       round((total_invoices - missing_invoices) * 100.0::DOUBLE / total_invoices, 2) AS match_rate_pct
FROM tally""")]


def j28() -> str:
    return with_fixtures(["invoice_header", "ledger"], _missing("created_by_id"), "FROM rated")


def j29() -> str:
    return with_fixtures(["invoice_header", "ledger"], [*_missing("supplier_id"), ("grand", """
SELECT CAST(sum(total_invoices) AS BIGINT) AS grand_total_invoices, CAST(sum(missing_invoices) AS BIGINT) AS grand_total_missing,
       CAST(sum(matched_invoices) AS BIGINT) AS grand_total_matched,
       round(CAST(sum(missing_invoices) AS DOUBLE) * 100.0 / sum(total_invoices), 2) AS overall_missing_rate_pct FROM rated""")],
                         "SELECT * FROM rated, grand")


# ------------------------------------------------------------------- coverage
# values that are not a plain column
DIMENSION_SQL = {
    ("D", "custom_fields:supplier-category.lookup.name"): "json_extract_string(d.custom_fields, '$.\"supplier-category\".lookup.name')",
}
COVERAGE_FIXTURES = ["invoice_header", "supplier_dim", "supplier_information", "ledger", "exchange_rate"]


def _dimension(table: str, column: str) -> str:
    return DIMENSION_SQL.get((table, column), f"{table.lower()}.{column}")


def _covered(value: str, name: str = "value", amounts: bool = False, information: bool = True, extra: str = "", where: str = "") -> str:
    """Counts (and thousands of USD) of one dimension's values; a header weighs its ledger matches of the period."""
    usd = f"CAST(a.gross_total AS DOUBLE) / ifnull(rate, 1) * {WEIGHT}"
    money = f"""
       round(ifnull(sum({usd}) FILTER (k IS NOT NULL), 0) / 1000, 1) AS both_total_usd_k,
       round(ifnull(sum({usd}) FILTER (k IS NULL), 0) / 1000, 1) AS source_only_total_usd_k,
       round(sum({usd}) / 1000, 1) AS total_usd_k,""" if amounts else ""
    rates = f"LEFT JOIN monthly ON (to_currency_id, rate_month) = (a.currency_id, {month('CAST(a.payment_date AS DATE)')})" if amounts else ""
    return f"""
SELECT {value} AS {name}, CAST(ifnull(sum(k), 0) AS BIGINT) AS both_count, count(*) FILTER (k IS NULL) AS source_only_count,
       CAST(sum({WEIGHT}) AS BIGINT) AS total_count,{money}
       round(CAST(ifnull(sum(k), 0) AS DOUBLE) * 100.0 / sum({WEIGHT}), 2) AS both_pct,
       round(CAST(count(*) FILTER (k IS NULL) AS DOUBLE) * 100.0 / sum({WEIGHT}), 2) AS source_only_pct
FROM invoice_header a JOIN supplier_dim b ON b.id = a.supplier_id
LEFT JOIN hits ON hit_number = a.invoice_number {rates}
{"LEFT JOIN supplier_information d ON d.supplier_id = b.id" if information else ""} {extra}
WHERE CAST(a.payment_date AS DATE) {PERIOD} {where} GROUP BY 1"""


def _ranked(sort_by: list[str]) -> str:
    return ", ".join([f"{c} DESC NULLS FIRST" for c in sort_by] + ["variable_value ASC NULLS LAST"])


def j30(subset: bool) -> str:
    chosen = f"AND a.supplier_id IN ({', '.join(map(str, P.TIER_SUBSET))})" if subset else ""
    tiers = """LEFT JOIN (SELECT s.id AS tiered, json_extract_string(f.value, '$.name') AS tier
      FROM supplier_dim s, json_each(s.custom_fields) f WHERE f.key = 'supplier-tier') ON tiered = b.id"""
    return with_fixtures(["invoice_header", "supplier_dim", "ledger"], [PERIOD_HITS],
                         _covered("tier", "supplier_tier_value", information=False, extra=tiers, where=chosen))


def j31(table: str, column: str, display: str, top_n: int | None, sort_by: list[str], with_d: bool = True,
        amounts: bool = False) -> str:
    ctes = [PERIOD_HITS, ("monthly", rates_per_month()),
            ("covered", _covered(_dimension(table, column), "variable_value", amounts, with_d))]
    limit = f"LIMIT {top_n}" if top_n is not None else ""
    return with_fixtures(COVERAGE_FIXTURES, ctes, f"""
SELECT *, '{table}' AS table_alias, '{column}' AS variable_name, '{display}' AS display_name
FROM covered ORDER BY {_ranked(sort_by)} {limit}""")


def j33(dims: list[tuple[str, str, str]], top_n: int, sort_by: list[str], amounts: bool) -> str:
    ctes = [PERIOD_HITS, ("monthly", rates_per_month())]
    for i, (table, column, _) in enumerate(dims):
        ctes.append((f"covered_{i}", _covered(f"CAST({_dimension(table, column)} AS VARCHAR)", "variable_value", amounts)))
    each = [
        f"SELECT {i} AS dim_id, '{t}' AS table_alias, '{c}' AS variable_name, '{d.replace(chr(39), chr(39) * 2)}' AS display_name, * FROM covered_{i}"
        for i, (t, c, d) in enumerate(dims)
    ]
    ctes.append(("swept", "\nUNION ALL ".join(each)))
    return with_fixtures(COVERAGE_FIXTURES, ctes, f"""
SELECT *, CAST(row_number() OVER (PARTITION BY dim_id ORDER BY {_ranked(sort_by)}) AS INTEGER) AS rank
FROM swept QUALIFY rank <= {top_n}""")


def _damaged_sweep(dims: list[tuple[str, str, str]]) -> tuple[dict, list[tuple[str, str]], list[str]]:
    """Fixtures with unreadable documents, one table expression per dimension, and the condition of an unreadable value."""
    deps, whole = FIXTURES["supplier_information"]
    extra = {"supplier_information": (deps, f"""
SELECT * REPLACE (CASE WHEN supplier_id % {P.DAMAGED_EVERY} = 0 THEN '{P.DAMAGED_JSON}' ELSE custom_fields END AS custom_fields) FROM ({whole})""")}
    ctes, invalid = [PERIOD_HITS, ("monthly", rates_per_month())], []
    for i, (table, column, _) in enumerate(dims):
        value, bad = _dimension(table, column), "FALSE"
        if (table, column) in DIMENSION_SQL:
            value, bad = f"CASE WHEN json_valid(d.custom_fields) THEN {value} END", "NOT json_valid(d.custom_fields)"
        ctes.append((f"covered_{i}", _covered(f"CAST({value} AS VARCHAR)", "variable_value")))
        invalid.append(bad)
    return extra, ctes, invalid


def j33_isolated(dims: list[tuple[str, str, str]], top_n: int, sort_by: list[str]) -> str:
    extra, ctes, _ = _damaged_sweep(dims)
    each = [f"SELECT {i} AS dim_id, '{t}' AS table_alias, '{c}' AS variable_name, '{d}' AS display_name, * FROM covered_{i}"
            for i, (t, c, d) in enumerate(dims)]
    return with_fixtures(COVERAGE_FIXTURES, [*ctes, ("swept", "\nUNION ALL ".join(each))], f"""
SELECT *, CAST(row_number() OVER (PARTITION BY dim_id ORDER BY {_ranked(sort_by)}) AS INTEGER) AS rank
FROM swept QUALIFY rank <= {top_n}""", extra)


def j33_report(dims: list[tuple[str, str, str]], bad: list[tuple[str, str, str, str, str]]) -> str:
    extra, ctes, invalid = _damaged_sweep(dims)
    each = [f"""
SELECT {i} AS dim_id, '{t}' AS table_alias, '{c}' AS variable_name, '{d}' AS display_name, 'ok' AS status, NULL AS reason,
       (SELECT count(*) FROM covered_{i}) AS value_count,
       (SELECT CAST(ifnull(sum({WEIGHT}) FILTER ({invalid[i]}), 0) AS BIGINT) FROM invoice_header a JOIN supplier_dim b ON b.id = a.supplier_id
        LEFT JOIN hits ON hit_number = a.invoice_number LEFT JOIN supplier_information d ON d.supplier_id = b.id
        WHERE CAST(a.payment_date AS DATE) {PERIOD}) AS invalid_count""" for i, (t, c, d) in enumerate(dims)]
    each += [f"SELECT {len(dims) + i}, '{t}', '{c}', '{d}', '{status}', '{reason}', NULL, NULL"
             for i, (t, c, d, status, reason) in enumerate(bad)]
    return with_fixtures(COVERAGE_FIXTURES, ctes, "\nUNION ALL ".join(each), extra)


def match_labels() -> str:
    return with_fixtures(["invoice_header", "ledger"], [PERIOD_HITS], f"""
SELECT id, invoice_number, supplier_id, CASE WHEN k IS NULL THEN 'SOURCE ONLY' ELSE 'BOTH' END AS match_label,
       CAST(ifnull(k, 0) AS BIGINT) AS ledger_rows
FROM invoice_header LEFT JOIN hits ON hit_number = invoice_number WHERE CAST(payment_date AS DATE) {PERIOD}""")


# -------------------------------------------------------------------- reports
def j37() -> str:
    return with_fixtures(["invoice_header", "currency"], [], f"""
SELECT currency_id, code FROM invoice_header h LEFT JOIN currency ON currency.id = currency_id
WHERE h.payment_date > DATE '{P.PAID_AFTER}'""")


def j38() -> str:
    return with_fixtures(["survey"], [], f"""
SELECT {month('survey_date')} AS survey_month, round(avg(csat_score), 4) AS avg_csat, count(*) AS responses,
       count(DISTINCT customer_id) AS customers
FROM survey WHERE survey_date {PERIOD} GROUP BY ALL""")


def j39() -> str:
    return with_fixtures(["receivables"], [], """
SELECT payment_status, CAST(sum(CAST(invoice_amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total_amount,
       count(*) AS invoice_count, count(DISTINCT customer_id) AS customer_count
FROM receivables WHERE payment_status IN ('Paid', 'Overdue', 'Pending') GROUP BY ALL""")


def j40() -> str:
    return with_fixtures(["invoice_header"], [("aging", aging_sql(P.AS_OF))], """
SELECT invoice_id, customer_name, days_overdue, outstanding_balance,
       row_number() OVER (ORDER BY outstanding_balance DESC NULLS LAST, invoice_id ASC) <= 5 AS is_top
FROM aging WHERE days_overdue > 90""")


def j41() -> str:
    return with_fixtures(["vendor_payments"], [("slipped", f"""
SELECT vendor_name, paid_amount, payment_date - net_due_date AS slip FROM vendor_payments WHERE CAST(payment_date AS DATE) {PERIOD}""")], """
SELECT vendor_name, CAST(sum(CAST(paid_amount AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS paid_amount, count(*) AS invoice_count,
       count(*) FILTER (slip > 0) AS late_count, round(CAST(count(*) FILTER (slip > 0) AS DOUBLE) / count(*), 4) AS late_share,
       round(avg(slip) FILTER (slip > 0), 2) AS avg_days_late
FROM slipped GROUP BY ALL""")


# ------------------------------------------------------------------ profiling
def _unpivot_text(cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM lineitem WHERE {c} IS NOT NULL" for c in cols
    )


def j36() -> str:
    cols = P.PROFILE_COLUMNS
    return with_fixtures([], [
        ("long", _unpivot_text(cols)),
        ("freq", "SELECT column_name, value, COUNT(*) AS count FROM long GROUP BY 1, 2"),
        ("nn", "SELECT column_name, SUM(count) AS non_null_ct FROM freq GROUP BY 1"),
    ], f"""
SELECT column_name, rank, value, count,
       CAST(printf('%.2f', CAST(count AS DOUBLE) / non_null_ct * 100.0) AS DOUBLE) AS percentage
FROM (SELECT f.*, n.non_null_ct,
             ROW_NUMBER() OVER (PARTITION BY f.column_name ORDER BY f.count DESC, f.value ASC) AS rank
      FROM freq f JOIN nn n USING (column_name))
WHERE rank <= {P.TOP_VALUES}""")


def j36_counts() -> str:
    return f"SELECT column_name, COUNT(*) AS top_values_returned FROM ({j36()}) GROUP BY 1"


def j36_excluded() -> str:
    frame = "SELECT *, CAST(NULL AS VARCHAR) AS never_given, CASE WHEN l_linenumber = 1 THEN l_tax END AS at_times FROM lineitem"
    empty = [f"SELECT '{c}' AS column_name FROM frame HAVING count({c}) = 0" for c in [*P.PROFILE_COLUMNS, *P.DERIVED_COLUMNS]]
    return f"WITH frame AS ({frame})\n" + " UNION ALL\n".join(empty)


def j35() -> str:
    cols = P.PROFILE_COLUMNS
    return with_fixtures([], [
        ("long", _unpivot_text(cols)),
        ("vals", "SELECT DISTINCT column_name, value FROM long"),
        ("cnt", "SELECT column_name, COUNT(*) AS unique_count FROM vals GROUP BY 1"),
    ], "SELECT v.column_name, c.unique_count, v.value, TRY_CAST(v.value AS DOUBLE) AS numeric_value "
        "FROM vals v JOIN cnt c USING (column_name)")


def j34() -> str:
    rows = []
    for c in P.PROFILE_COLUMNS:
        dtype = P.PROFILE_TYPES[c]
        common = f"""'{c}' AS attribute, '{dtype}' AS dtype, COUNT(*) AS row_count, COUNT({c}) AS non_null_ct,
       COUNT(*) - COUNT({c}) AS null_ct, COUNT(DISTINCT {c}) AS distinct_ct"""
        if dtype in ("bigint", "int", "double"):
            x = f"CAST({c} AS DOUBLE)"

            def f(e: str) -> str:
                return f"COALESCE(printf('%.2f', {e}), 'nan')"

            details = (
                f"'Min: ' || {f(f'MIN({x})')} || ', Med: ' || {f(f'quantile_cont({x}, 0.5)')} || ', Mean: ' || "
                f"{f(f'AVG({x})')} || ', Max: ' || {f(f'MAX({x})')} || ', P90: ' || {f(f'quantile_cont({x}, 0.9)')} || "
                f"', P95: ' || {f(f'quantile_cont({x}, 0.95)')}"
            )
            rows.append(f"SELECT {common}, {details} AS details FROM lineitem")
        elif dtype.startswith("timestamp"):
            details = f"'Min: ' || COALESCE(CAST(MIN({c}) AS VARCHAR), 'NaT') || ', Max: ' || COALESCE(CAST(MAX({c}) AS VARCHAR), 'NaT')"
            rows.append(f"SELECT {common}, {details} AS details FROM lineitem")
        else:
            top = f"""(SELECT 'Top 3: ' || COALESCE(string_agg(v || ' (' || printf('%.1f', CAST(n AS DOUBLE) / tot * 100.0) || '%)', ', ' ORDER BY n DESC, v ASC), '')
   FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS tot,
                ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR) ASC) AS r
         FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) WHERE r <= 3)"""
            rows.append(f"SELECT {common}, {top} AS details FROM lineitem")
    return with_fixtures([], [], "\nUNION ALL\n".join(rows))


def _in_order(frame: str, cols: list[tuple[str, str]]) -> str:
    """Each column's distinct values with their places; ``cols``: name and the text of a value ``v``."""
    return "\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, row_number() OVER (ORDER BY v) AS position, count(*) OVER () AS unique_count, {text} AS value
FROM (SELECT DISTINCT {c} AS v FROM {frame} WHERE {c} IS NOT NULL)""" for c, text in cols)


def j35_in_order() -> str:
    return _in_order("lineitem", [(c, "CAST(v AS VARCHAR)") for c in P.PROFILE_COLUMNS])


EDGE_VALUES = """edges AS (
SELECT CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS quantity_or_null,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS tax_or_nan,
       CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN CAST('-inf' AS DOUBLE) ELSE l_discount END AS discount_or_infinite,
       CAST(9007199254740992 AS BIGINT) + l_orderkey % 64 AS beyond_double,
       CAST(CAST('12345678901234567890' AS DECIMAL(38,2)) + CAST(l_linenumber AS DECIMAL(10,2)) * CAST('0.01' AS DECIMAL(4,2)) AS DECIMAL(38,2)) AS wide_decimal,
       CAST(CAST(l_linenumber AS DECIMAL(10,2)) - 4 AS DECIMAL(10,2)) AS signed_decimal,
       CAST(l_shipdate AS DATE) AS day, l_orderkey % 3 = 0 AS flag, CAST(NULL AS VARCHAR) AS nothing,
       CAST(l_quantity AS FLOAT) AS short_float, l_shipdate AS moment
FROM lineitem)"""
EDGE_TYPES = {
    "quantity_or_null": "double", "tax_or_nan": "double", "discount_or_infinite": "double", "beyond_double": "bigint",
    "wide_decimal": "decimal(38,2)", "signed_decimal": "decimal(10,2)", "day": "date", "flag": "boolean", "nothing": "string",
    "short_float": "float", "moment": "timestamp_ntz",
}


def j35_edges_in_order() -> str:
    text = {"discount_or_infinite": "CASE WHEN isinf(v) THEN '-Infinity' ELSE CAST(v AS VARCHAR) END"}
    return f"WITH {EDGE_VALUES}" + _in_order("edges", [(c, text.get(c, "CAST(v AS VARCHAR)")) for c in EDGE_TYPES])


def j34_edges() -> str:
    rows = []
    for c, dtype in EDGE_TYPES.items():
        if dtype.startswith("decimal") or dtype in ("double", "float", "bigint"):
            x = f"CAST(CAST({c} AS VARCHAR) AS DOUBLE)" if dtype.startswith("decimal") else f"CAST({c} AS DOUBLE)"
            exact = f"CAST(CAST(sum({c}) AS VARCHAR) AS DOUBLE) / count({c})" if dtype.startswith(("decimal", "big")) else f"avg({x})"
            stats = [("Min", f"min({x})"), ("Med", f"quantile_cont({x}, 0.5)"), ("Mean", exact), ("Max", f"max({x})"),
                     ("P90", f"quantile_cont({x}, 0.9)"), ("P95", f"quantile_cont({x}, 0.95)")]
            details = " || ', ' || ".join(f"'{n}: ' || coalesce(printf('%.2f', {e}), 'nan')" for n, e in stats)
        elif dtype.startswith("timestamp"):
            details = f"'Min: ' || min({c}) || ', Max: ' || max({c})"
        else:
            details = f"""(SELECT 'Top 3: ' || coalesce(string_agg(v || ' (' || printf('%.1f', n * 100.0::DOUBLE / total) || '%)', ', ' ORDER BY n DESC, v), '')
  FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, sum(count(*)) OVER () AS total FROM edges WHERE {c} IS NOT NULL GROUP BY 1
        QUALIFY row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) <= 3))"""
        rows.append(f"""
SELECT '{c}' AS attribute, '{dtype}' AS dtype, count(*) AS row_count, count({c}) AS non_null_ct, count(*) - count({c}) AS null_ct,
       count(DISTINCT {c}) AS distinct_ct, {details} AS details FROM edges""")
    return f"WITH {EDGE_VALUES}" + "\nUNION ALL".join(rows)
