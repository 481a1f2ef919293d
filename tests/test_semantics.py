"""Hand-made rows for each NULL / date / rounding rule the jobs must keep."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from apflow.functions.dates import day_diff, in_window, month_label, month_start
from apflow.functions.measures import bucket_amounts, payment_term_days, region_of, to_usd, total_usd
from apflow.operators.invoices import dedupe_invoices, valid_invoices
from apflow.operators.rates import latest_rate_in_window, monthly_rates


def _headers(spark, rows):
    schema = T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("invoice_number", T.StringType()),
        T.StructField("payment_date", T.TimestampNTZType()),
        T.StructField("invoice_date", T.DateType()),
        T.StructField("net_due_date", T.DateType()),
        T.StructField("gross_total", T.DecimalType(18, 2)),
        T.StructField("currency_id", T.LongType()),
        T.StructField("supplier_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("document_type", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)


D = dt.date(2025, 1, 10)


def _row(i, num="A", paid=dt.datetime(2025, 1, 15), gross="10.00", ccy=1, sup=1, status="APPROVED"):
    return (i, num, paid, D, D + dt.timedelta(days=30), Decimal(gross), ccy, sup, status, "Invoice")


def test_n1_inequality_drops_nulls(spark):
    h = _headers(spark, [_row(1, status=None), _row(2, status="Voided"), _row(3), _row(4, ccy=None)])
    out = valid_invoices(h, "2025-01-01", "2025-12-31", "loose", excluded_currency=144)
    assert sorted(r.id for r in out.collect()) == [3]


def test_n2_not_in_subquery_null_semantics(spark):
    h = _headers(spark, [_row(1, sup=None), _row(2, sup=7), _row(3, sup=8)])
    some = spark.createDataFrame([(7,)], "supplier_id long")
    none = spark.createDataFrame([], "supplier_id long")
    got_some = valid_invoices(h, None, None, "window_only", excluded_suppliers=some)
    got_none = valid_invoices(h, None, None, "window_only", excluded_suppliers=none)
    assert sorted(r.id for r in got_some.collect()) == [3]  # NULL supplier dropped
    assert sorted(r.id for r in got_none.collect()) == [1, 2, 3]  # kept when the list is empty


def test_n4_dedupe_puts_null_amount_first_then_smallest_id(spark):
    rows = [_row(1, gross="5.00"), _row(2, gross="9.00"), _row(3, gross="9.00")]
    rows.append((4, "A", dt.datetime(2025, 1, 15), D, D, None, 1, 1, "APPROVED", "Invoice"))
    out = dedupe_invoices(_headers(spark, rows)).collect()
    assert [r.id for r in out] == [4]
    out = dedupe_invoices(_headers(spark, rows[:3])).collect()
    assert [r.id for r in out] == [2]


def test_n5_window_bounds_on_timestamps(spark):
    last_day_8am = dt.datetime(2025, 12, 31, 8, 0)
    h = _headers(spark, [_row(1, paid=last_day_8am)])
    raw = h.where(in_window("payment_date", "2025-01-01", "2025-12-31")).count()
    cast = h.where(in_window("payment_date", "2025-01-01", "2025-12-31", date_cast=True)).count()
    assert (raw, cast) == (0, 1)


def test_n6_day_diff_counts_calendar_days(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2025, 1, 1, 23, 0), dt.datetime(2025, 1, 2, 1, 0))], "a timestamp_ntz, b timestamp_ntz"
    )
    assert df.select(day_diff("a", "b").alias("d")).first().d == 1


def test_n7_due_equals_paid_only_at_midnight(spark):
    df = spark.createDataFrame(
        [(D, dt.datetime(2025, 1, 10, 0, 0)), (D, dt.datetime(2025, 1, 10, 9, 0))], "due date, paid timestamp_ntz"
    )
    m = bucket_amounts(F.lit(100.0), F.lit(D), "due", "paid")
    got = [r.on for r in df.select(m["amount_paid_on_net_due_date"].alias("on")).collect()]
    assert got == [100, 0]


def test_n8_month_start_is_a_date(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 3, 17, 5, 0),)], "t timestamp_ntz")
    r = df.select(month_start("t").alias("m"), month_label("t").alias("l"))
    assert r.schema["m"].dataType == T.DateType()
    assert r.first().m == dt.date(2025, 3, 1) and r.first().l == "2025-03"


def test_n9_payment_term_days(spark):
    df = spark.createDataFrame(
        [("Due Upon Receipt",), ("Net 30",), ("Net 120",), ("Custom",), (None,), ("Pay now",)], "code string"
    )
    got = [r.d for r in df.select(payment_term_days("code", ["Due Upon Receipt", "Pay now"]).alias("d")).collect()]
    assert got == [0, 30, 20, None, None, 0]


def test_n10_n11_conversion_policies(spark):
    df = spark.createDataFrame([(Decimal("10.00"), None), (Decimal("10.00"), 2.0)], "amt decimal(18,2), rate double")
    r = df.select(
        to_usd("amt", "rate", "divide", "one").alias("d1"),
        to_usd("amt", "rate", "divide", "null").alias("dn"),
        to_usd("amt", "rate", "multiply", "one").alias("m1"),
    ).collect()
    assert [(x.d1, x.dn, x.m1) for x in r] == [(10.0, None, 10.0), (5.0, 5.0, 20.0)]


def test_n13_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.5,)], "x double")
    assert [r.t for r in df.select(total_usd(F.col("x")).alias("t")).collect()] == [3, -3, 1]


def test_n14_null_keys_group_together(spark):
    rows = [_row(1, num=None, gross="1.00"), _row(2, num=None, gross="2.00"), _row(3, num="B")]
    out = dedupe_invoices(_headers(spark, rows)).collect()
    assert sorted((r.invoice_number or "", r.id) for r in out) == [("", 2), ("B", 3)]


def test_region_map_unmapped_and_null_give_empty(spark):
    df = spark.createDataFrame([("Entity 1",), ("Nowhere",), (None,)], "n string")
    got = [r.r for r in df.select(region_of("n", {"Entity 1": "AMER"}).alias("r")).collect()]
    assert got == ["AMER", "", ""]


def test_latest_rate_tie_break_is_deterministic(spark):
    schema = "id long, from_currency_id long, to_currency_id long, rate double, created_at date, rate_date date"
    rates = spark.createDataFrame(
        [(1, 1, 5, 1.1, D, D), (2, 1, 5, 1.2, D, D), (3, 2, 5, 9.9, D, D), (4, 1, 5, 1.0, None, None)], schema
    )
    w = latest_rate_in_window(rates, 1, "2025-01-01", "2025-01-31").collect()
    assert [r.id for r in w] == [2]  # NULL created_at is outside the window; newest id wins the tie
    m = monthly_rates(rates, None, None).collect()
    assert sorted((r.rate_month, r.rate) for r in m if r.rate_month) == [(dt.date(2025, 1, 1), 9.9)]
