"""Profilers against a pandas brute force of the same definitions on small inputs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apflow.operators import profile
from tests.conftest import SMALL


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    got = {r.prob: r.value for r in profile.exact_quantiles(df, ["x"], [0.0, 0.5, 0.9, 0.95, 1.0]).collect()}
    data = np.array([v for v in values if v is not None], dtype=float)
    if len(data) == 0:
        assert got == {}
        return
    for p, v in got.items():
        assert abs(v - np.quantile(data, p)) < 1e-9


WIDE = st.floats(allow_nan=True, allow_infinity=True, width=64)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), WIDE), min_size=1, max_size=80), st.sampled_from([1 << 6, 1 << 15]))
def test_quantiles_of_any_doubles_are_selected_exactly(spark, values, rows):
    probs = [0.0, 0.25, 0.5, 0.9, 0.95, 1.0]
    df = spark.createDataFrame([(v, None if v is None else -v) for v in values], "x double, `y z` double")
    old, profile.HISTOGRAM_ROWS = profile.HISTOGRAM_ROWS, rows  # few parts: more passes
    try:
        got = {(r.column_name, r.prob): r.value for r in profile.exact_quantiles(df, ["x", "y z"], probs).collect()}
    finally:
        profile.HISTOGRAM_ROWS = old
    data = sorted(v for v in values if v is not None and v == v)
    for name, own in (("x", data), ("y z", sorted(-v for v in data))):
        for p in probs if own else []:
            h = (len(own) - 1) * p
            a, b = own[math.floor(h)], own[math.ceil(h)]
            want = a if a == b else a + (h - math.floor(h)) * (b - a)
            assert got[name, p] == want or (want != want and got[name, p] != got[name, p])
    assert len(got) == (2 * len(probs) if data else 0)


def test_selection_needs_few_passes_and_a_small_shuffle(spark):
    """A third of a column on one value, and ranges that narrow by twenty orders of magnitude."""
    x = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.lit(10.0), F.col("id") % 40 - 20) * (1 + F.col("id") / 1e6))
    df = spark.range(60_000).select(x.alias("x"), (F.col("id") % 1000).alias("n"))
    passes, real = [], type(spark).sql
    import unittest.mock as mock

    with mock.patch.object(type(spark), "sql", lambda self, *a, **k: (passes.append(1), real(self, *a, **k))[1]):
        got = {(r.column_name, r.prob): r.value for r in profile.exact_quantiles(df, ["x", "n"], [0.1, 0.5, 0.99]).collect()}
    pdf = df.toPandas()
    for c in ("x", "n"):
        for p in (0.1, 0.5, 0.99):
            assert got[c, p] == pytest.approx(np.quantile(pdf[c], p), rel=1e-12)
    assert len(passes) <= 6


def test_top_n_values_match_pandas(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_returnflag", "l_quantity", "l_linenumber")
    got = profile.top_n_values(li, li.columns, 3).toPandas()
    pdf = li.toPandas()
    for c in li.columns:
        vc = pdf[c].value_counts()
        top = sorted(vc.items(), key=lambda kv: (-kv[1], str(kv[0])))[:3]
        mine = got[got.column_name == c].sort_values("rank")
        assert list(mine["count"]) == [n for _, n in top]
        assert list(mine["value"]) == [str(v) for v, _ in top]
        assert list(mine["percentage"]) == [round(n / pdf[c].notna().sum() * 100, 2) for _, n in top]


def test_top_value_counts_per_column(spark):
    d = spark.createDataFrame([("a", i, None) for i in range(5)], "one string, many int, none string")
    assert {tuple(r) for r in profile.top_value_counts(d, d.columns, 3).collect()} == {("one", 1), ("many", 3)}


def test_data_snapshot_numeric_details_match_pandas(spark):
    li = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_quantity", "l_discount", "l_returnflag")
    snap = {r.attribute: r for r in profile.data_snapshot(li).collect()}
    pdf = li.toPandas()
    d = pdf["l_quantity"].describe(percentiles=[0.5, 0.9, 0.95])
    want = (f"Min: {d['min']:.2f}, Med: {d['50%']:.2f}, Mean: {d['mean']:.2f}, "
            f"Max: {d['max']:.2f}, P90: {d['90%']:.2f}, P95: {d['95%']:.2f}")
    assert snap["l_quantity"].details == want
    top = pdf["l_returnflag"].value_counts(normalize=True)
    top = sorted(top.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    assert snap["l_returnflag"].details == "Top 3: " + ", ".join(f"{v} ({p:.1%})" for v, p in top)
    assert snap["l_returnflag"].distinct_ct == pdf["l_returnflag"].nunique()


def test_all_null_columns_are_excluded(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a long, b string")
    assert [r.column_name for r in profile.all_null_columns(df, ["a", "b", "zz"]).collect()] == ["b"]
    assert profile.top_n_values(df, ["a", "b"], 5).where("column_name = 'b'").count() == 0


def test_unique_values_have_a_native_order(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (9, None)], "n long, s string")
    rows = profile.unique_values(df, ["n", "s"]).orderBy("column_name", "numeric_value", "value").collect()
    assert [(r.column_name, r.unique_count, r.value, r.numeric_value) for r in rows] == [
        ("n", 2, "9", 9.0), ("n", 2, "10", 10.0), ("s", 2, "a", None), ("s", 2, "b", None)]


def test_snapshot_is_exact_for_wide_numbers_and_skips_nan(spark):
    from decimal import Decimal

    nan = float("nan")
    big = 2**53
    df = spark.createDataFrame(
        [(big, Decimal("12345678901234567890.01"), 1.0, None), (big + 1, Decimal("12345678901234567890.02"), nan, None),
         (big + 2, Decimal("12345678901234567890.03"), 2.0, None)], "i long, d decimal(38,2), f double, e string")
    out = {r.attribute: r for r in profile.data_snapshot(df).collect()}
    assert (out["i"].distinct_ct, out["d"].distinct_ct) == (3, 3)
    assert (out["f"].non_null_ct, out["f"].null_ct, out["f"].distinct_ct) == (2, 1, 2)
    assert "Max: 2.00" in out["f"].details and "Med: 1.50" in out["f"].details
    assert (out["e"].non_null_ct, out["e"].distinct_ct, out["e"].details) == (0, 0, "Top 3: ")
    assert {r.value for r in profile.unique_values(df, ["f"]).collect()} == {"1.0", "2.0"}


def test_snapshot_of_an_empty_frame_has_a_row_per_column(spark):
    out = {r.attribute: r for r in profile.data_snapshot(spark.createDataFrame([], "a long, b string")).collect()}
    assert set(out) == {"a", "b"} and all(r.row_count == 0 and r.distinct_ct == 0 for r in out.values())


def test_places_of_values_follow_the_native_order(spark):
    from datetime import date, datetime
    from decimal import Decimal

    big = 2**53
    rows = [(n, d, f, t, b, day, at) for n, d, f, t, b, day, at in zip(
        [10, 9, -5, big + 1, big, None, 9], map(Decimal, ["1.50", "-10.25", "-9.25", "0.00", "100.00", "-0.01", "2.00"]),
        [1.5, float("nan"), -0.0, 0.0, float("inf"), float("-inf"), 10.0], ["b", "a", "B", "é", "", None, "aa"],
        [True, False, None, True, True, False, None], [date(2024, 1, 2), date(1969, 5, 1), None, *[date(2024, 1, 1)] * 4],
        [datetime(2024, 1, 1, 0, 0, 0, 5), datetime(2024, 1, 1), *[None] * 5], strict=True)]
    df = spark.createDataFrame(rows, "n long, d decimal(38,2), f double, t string, b boolean, day date, at timestamp_ntz")
    cols = [*df.columns, "missing"]
    got = {}
    for r in profile.ordered_unique_values(df, cols).collect():
        got.setdefault(r.column_name, {})[r.position] = r.value
    want = {
        "n": ["-5", "9", "10", str(big), str(big + 1)],
        "d": ["-10.25", "-9.25", "-0.01", "0.00", "1.50", "2.00", "100.00"],
        "f": ["-Infinity", "0.0", "1.5", "10.0", "Infinity"], "t": ["", "B", "a", "aa", "b", "é"],
        "b": ["false", "true"], "day": ["1969-05-01", "2024-01-01", "2024-01-02"],
        "at": ["2024-01-01 00:00:00", "2024-01-01 00:00:00.000005"]}
    assert {c: [v[i + 1] for i in range(len(v))] for c, v in got.items()} == want


def test_places_agree_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    rows = profile.ordered_unique_values(df, ["a", "b"]).collect()
    a = sorted((r.position, int(r.value)) for r in rows if r.column_name == "a")
    assert [p for p, _ in a] == list(range(1, 5001)) and [v for _, v in a] == sorted(v for _, v in a)
    assert {r.unique_count for r in rows if r.column_name == "a"} == {5000}
    assert profile.ordered_unique_values(df.limit(0), ["a", "b"]).count() == 0
    assert profile.ordered_unique_values(df, ["zz"]).count() == 0


def test_snapshot_of_infinities_and_huge_sums(spark):
    from decimal import Decimal

    most = Decimal("9" * 36 + ".99")
    df = spark.createDataFrame([(float("inf"), most, "x"), (1.0, most, None), (float("-inf"), most, "x")], "a double, `b c` decimal(38,2), s string")
    out = {r.attribute: r for r in profile.data_snapshot(df).collect()}
    assert out["a"].details.startswith("Min: -inf, Med: 1.00, Mean: nan, Max: inf")
    assert out["b c"].details.startswith(f"Min: {1e36:.2f}, ") and out["b c"].distinct_ct == 1
    assert out["s"].details == "Top 3: x (100.0%)"
