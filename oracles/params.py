"""Parameters shared by the registered Spark queries and their DuckDB oracles.

Windows cover the whole testdata range (orders 1995-01 .. 2001-08, payments up
to ~2001-11), so every registered query reads its whole tables.
"""

START = "1995-01-01"
END = "2001-12-31"
RATES_SINCE = "1995-01-01"
LEDGER_AFTER = "1994-12-31"
PAID_AFTER = "1994-12-31"
BASE_CURRENCY = 1
EXCLUDED_CURRENCY = 24  # plays the reference's excluded currency in the fixture
MIN_PCT_MISSING = 90.0
TOP_PROBLEM_SUPPLIERS = 40
MIN_INVOICES = 10
AS_OF = "2001-12-31"
# J14's literal exclusion list and J30's supplier subset (fixture supplier ids)
EXCLUDED_SUPPLIERS = list(range(1, 16))
TIER_SUBSET = list(range(1, 9))
PROFILE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
# made for the excluded list: one column without any value, one with some
DERIVED_COLUMNS = ["never_given", "at_times"]
PROFILE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
TOP_VALUES = 5
# made for the isolated sweep: every n-th supplier's document is cut off
DAMAGED_EVERY = 11
DAMAGED_JSON = '{"supplier-category": {"lookup"'
