"""Column profiling: snapshot, unique values, top-N values.

Value lists start from one *value-frequency table*: the profiled columns are
unpivoted to one row per cell (an ``Expand``, inside code generation) and
counted with a ``groupBy`` per kind (whole numbers, doubles, texts), a partial
aggregate, so a value that fills a third of a column becomes one row per map
task. A value becomes text only after the count. Distinct counts and top-N lists
are read off that table; its exchanges are shared within a query.

Exact quantiles are selected without sorting or writing any values: each pass
counts the values per range of a histogram between known bounds, and the ranges
that hold a wanted position become the next pass's bounds (:func:`exact_quantiles`).

Numbers are formatted the way Python formats them (``f"{x:.2f}"``,
``round(x, 2)``): rounding of the exact binary value, ties to even. Spark's
``format_number`` with a pattern does exactly that; ``format_string`` and
``bround`` round the shortest decimal text instead and differ on ties.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apflow.operators.joins import materialize

log = logging.getLogger(__name__)

SNAPSHOT_QUANTILES = (0.5, 0.9, 0.95)
# rows of histogram that one pass of the selection may send to the driver
HISTOGRAM_ROWS = 1 << 15


def py_fixed(x: Column, decimals: int) -> Column:
    """Python ``f"{x:.{decimals}f}"`` as a string column."""
    pattern = "0." + "0" * decimals if decimals > 0 else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def py_round(x: Column, decimals: int) -> Column:
    """Python ``round(x, decimals)`` on a double column."""
    return py_fixed(x, decimals).cast("double")


def _is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def _is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType))


def _present(c: str, dt: T.DataType) -> Column:
    """The column with NaN, which is no value, as NULL."""
    x = F.col(f"`{c}`")
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(x), x)
    return x


def present_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns of ``cols`` that exist in ``df`` (the others are logged and skipped)."""
    have = set(df.columns)
    out = []
    for c in cols:
        if c in have:
            out.append(c)
        else:
            log.warning("column %r not found; skipped", c)
    return out


def _kind(dt: T.DataType) -> str:
    """Which kind of value a column is counted as: i(nteger), d(ouble) or s (text)."""
    if isinstance(dt, (T.IntegralType, T.DateType)):
        return "i"
    return "d" if isinstance(dt, (T.DoubleType, T.FloatType)) else "s"


def _typed_frequencies(df: DataFrame, cols: Sequence[str], keep_nulls: bool = False) -> DataFrame:
    """-> c (the column's place in ``cols``, as text), i, d, s, count: one row per distinct value of each column.

    The value is in the slot of its column's kind. The columns of a kind are unpivoted and counted together, so
    that the counting keys are narrow: three reads at most, each of its own columns, whatever their number.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    out = None
    for kind, sql_type in (("i", "bigint"), ("d", "double"), ("s", "string")):
        own = [(n, c) for n, c in enumerate(cols) if _kind(types[c]) == kind]
        if not own:
            continue
        values = []
        for n, c in own:
            value = F.unix_date(F.col(f"`{c}`")) if isinstance(types[c], T.DateType) else _present(c, types[c])
            values.append(value.cast(sql_type).alias(f"{n}"))
        cells = df.select(*values).unpivot([], [f"`{n}`" for n, _ in own], "c", kind)
        cells = cells if keep_nulls else cells.where(F.col(kind).isNotNull())
        counted = cells.groupBy("c", kind).agg(F.count(F.lit(1)).alias("count")).select("c", *[
            F.col(k) if k == kind else F.lit(None).cast(t).alias(k) for k, t in (("i", "bigint"), ("d", "double"), ("s", "string"))
        ], "count")
        out = counted if out is None else out.unionByName(counted)
    return out


def _name(cols: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c").cast("int") + 1)


def _text(df: DataFrame, cols: Sequence[str]) -> Column:
    """A counted value as the text that a cast of its column gives."""
    types = {f.name: f.dataType for f in df.schema.fields}
    dates = [str(n) for n, c in enumerate(cols) if isinstance(types[c], T.DateType)]
    floats = [str(n) for n, c in enumerate(cols) if isinstance(types[c], T.FloatType)]
    out = F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("d").cast("string"))
    if floats:
        out = F.when(F.col("c").isin(floats), F.col("d").cast("float").cast("string")).otherwise(out)
    if dates:
        out = F.when(F.col("c").isin(dates), F.date_from_unix_date(F.col("i").cast("int")).cast("string")).otherwise(out)
    return out


def value_frequencies(df: DataFrame, cols: Sequence[str], with_nulls: bool = False) -> DataFrame:
    """-> column_name, value (text), count; one row per distinct value.

    ``with_nulls`` keeps one NULL-value row per column that has any, so row and
    non-NULL counts can be read off the same table.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, value string, count bigint")
    freq = _typed_frequencies(df, cols, with_nulls)
    return freq.select(_name(cols).alias("column_name"), _text(df, cols).alias("value"), "count")


def _non_null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """-> column_name, row_count, non_null_ct (one wide aggregate, then unpivot)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(_present(c, types[c])).alias(f"_nn{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_nn{i}").alias("non_null_ct")) for i, c in enumerate(cols)
    ])
    return wide.select(F.col("_rows").alias("row_count"), F.explode(pairs).alias("_p")).select(
        "_p.column_name", "row_count", "_p.non_null_ct"
    )


def top_n_values(df: DataFrame, cols: Sequence[str], top_n: int = 5) -> DataFrame:
    """The ``top_n`` most frequent values of each column.

    -> column_name, rank, value, count, percentage (of non-NULL rows, Python
    ``round(.., 2)``). All-NULL columns produce no rows (see
    :func:`all_null_columns`). Equal counts are ordered by the value's text.
    ``row_number`` per column is planned with a partial group limit, so each
    map task forwards at most ``top_n`` values per column.
    """
    cols = present_columns(df, cols)
    freq = value_frequencies(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc())
    top = freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    # non-NULL rows per column, read off the same frequency table (no second scan)
    nn = freq.groupBy(F.col("column_name").alias("_nn_col")).agg(F.sum("count").alias("non_null_ct"))
    j = top.join(nn, top.column_name == nn._nn_col).drop("_nn_col")
    pct = F.col("count").cast("double") / F.col("non_null_ct") * F.lit(100.0)
    return j.select(
        "column_name",
        F.col("rank").cast("bigint").alias("rank"),
        "value",
        "count",
        py_round(pct, 2).alias("percentage"),
    )


def top_value_counts(df: DataFrame, cols: Sequence[str], top_n: int = 5) -> DataFrame:
    """How many rows :func:`top_n_values` has of each column.

    -> column_name, top_values_returned
    """
    return top_n_values(df, cols, top_n).groupBy("column_name").agg(F.count(F.lit(1)).alias("top_values_returned"))


def all_null_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The excluded list of J35/J36: columns whose every value is NULL (or no rows).

    -> column_name
    """
    cols = present_columns(df, cols)
    return _non_null_counts(df, cols).where(F.col("non_null_ct") == 0).select("column_name")


def unique_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """J35, long form: each distinct non-NULL value of each column.

    -> column_name, unique_count, value, numeric_value. Sort by ``column_name,
    numeric_value, value`` to list values in their native order (numeric_value
    is NULL for columns that are not numeric; ISO dates and booleans sort as
    text). The output is whole however many values a column has.
    """
    cols = present_columns(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if _is_numeric(types[c])]
    freq = value_frequencies(df, cols)
    counts = freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))
    # one row per column: the counts are as many as the columns
    number = F.when(F.col("column_name").isin(numeric), F.col("value").cast("double")) if numeric else F.lit(None).cast("double")
    return freq.join(F.broadcast(counts), "column_name").select("column_name", "unique_count", "value", number.alias("numeric_value"))


def _order_text(df: DataFrame, cols: Sequence[str]) -> Column:
    """Text that sorts as the values of the text slot do: decimals by sign and padded digits, others as they are."""
    types = {f.name: f.dataType for f in df.schema.fields}
    decimals = [str(n) for n, c in enumerate(cols) if isinstance(types[c], T.DecimalType)]
    if not decimals:
        return F.col("s")
    # the texts of a decimal column all have its scale, so their points are in line; of a negative number the
    # digits count backwards
    above = F.concat(F.lit("1"), F.lpad("s", 42, "0"))
    below = F.concat(F.lit("0"), F.translate(F.lpad(F.substring("s", 2, 42), 42, "0"), "0123456789", "9876543210"))
    return F.when(F.col("c").isin(decimals), F.when(F.col("s").startswith("-"), below).otherwise(above)).otherwise(F.col("s"))


def ordered_unique_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """J35 with the place of each distinct non-NULL value in its column's own order.

    -> column_name, position (from 1), unique_count, value. Numbers sort by value (wide integers and decimals
    exactly), dates, timestamps and booleans in their order, other values by their text's code points.

    The distinct values of all columns are range-partitioned together and written with the number of their
    range, so that every later step sees the same ranges; a value's position is its rank in its range plus the
    sizes of its column's ranges before, a table of ranges x columns. No column is gathered in one task.
    """
    cols = present_columns(df, cols)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, position bigint, unique_count bigint, value string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    freq = _typed_frequencies(df, cols).select("c", "i", "d", _order_text(df, cols).alias("k"), _text(df, cols).alias("value"))
    order = ["i", "d", "k"]
    ranged = materialize(freq.repartitionByRange(parts, "c", *order).withColumn("range", F.spark_partition_id()))
    within = Window.partitionBy("range", "c").orderBy(*order)
    sizes = ranged.groupBy("range", "c").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "range", "c", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
        F.sum("size").over(Window.partitionBy("c")).alias("unique_count"))
    placed = ranged.withColumn("nth", F.row_number().over(within)).join(offsets, ["range", "c"])
    return placed.select(_name(cols).alias("column_name"), (F.col("offset") + F.col("nth")).alias("position"), "unique_count", "value")


def _number(c: str, dt: T.DataType) -> Column:
    return _present(c, dt).cast("double")


def _bounds(df: DataFrame, cols: Sequence[str], extra: Sequence[Column] = ()) -> tuple:
    """One row, from one global aggregate: ``extra``, then of each column's numbers the count, the infinities, the finite bounds and the sum."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for c in cols:
        x = _number(c, types[c])
        finite = F.when(F.abs(x) < float("inf"), x)
        total = F.sum(x)
        if isinstance(types[c], (T.IntegralType, T.DecimalType)):  # exact, unless it is beyond 38 digits
            wide = T.DecimalType(38, types[c].scale if isinstance(types[c], T.DecimalType) else 0)
            total = F.coalesce(F.try_sum(F.col(f"`{c}`").cast(wide)).cast("double"), total)
        aggs += [F.count(x), F.count_if(x == float("-inf")), F.count_if(x == float("inf")), F.min(finite), F.max(finite), total]
    exprs = [*extra, *aggs]
    return tuple(df.agg(*[e.alias(f"_a{n}") for n, e in enumerate(exprs)]).first()) if exprs else ()


def _double(x: float) -> str:
    return f"double('{x!r}')"


def _part(x: str, lo: float, hi: float, parts: int, by_size: bool) -> str:
    """SQL: in which of ``parts`` parts of the range from ``lo`` to ``hi`` a value is; parts are in the order of the values.

    Equally wide parts, or (``by_size``) parts of equal ratio, for values of very different orders of magnitude.
    """
    largest = max(abs(lo), abs(hi))
    if by_size and lo > 0 and hi / lo > 1000:
        f = "ln({})".format
    elif by_size and hi < 0 and lo / hi > 1000:
        f = "-ln(-{})".format
    elif by_size and lo <= 0 <= hi and largest > 1e-290:
        scale = _double(min(2.0**60 / largest, 1e300))
        f = lambda v: f"signum({v}) * ln(1 + abs({v}) * {scale})"
    else:
        half = _double(0.5 if math.isinf(hi - lo) else 1.0)  # the width of a range may be beyond a double
        f = lambda v: f"{v} * {half}"
    a, b = f(_double(lo)), f(_double(hi))
    return f"least({parts - 1}L, cast(floor((({f(x)}) - ({a})) / (({b}) - ({a})) * {parts}) as bigint))"


def _selected(df: DataFrame, cols: Sequence[str], bounds: dict[str, tuple], wanted: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values at 0-based positions of columns in order; ``bounds``: (values below, least, largest) of the finite ones.

    A pass counts, for all ranges of all columns at once, the values in each of equally wide parts of the range, with
    the least and largest value there. Parts are in order, so running counts tell the part that holds a position. It
    is found if all of the part's values are equal; otherwise the part's own bounds are a range of the next pass. Any
    two values fall into different parts of the range between them, so a range shrinks in every pass. Where a part kept a
    large share of its range's values, the next pass divides it by orders of magnitude.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    ranges = [(c, *bounds[c], sorted(p), False) for c, p in wanted.items() if p]
    found: dict[tuple[str, int], float] = {}
    while ranges:
        for c, _, lo, hi, positions, _ in ranges:
            if lo == hi:
                found |= {(c, p): lo for p in positions}
        ranges = [r for r in ranges if r[2] != r[3]]
        if not ranges:
            break
        parts = max(16, HISTOGRAM_ROWS // len(ranges))
        used = list(dict.fromkeys(r[0] for r in ranges))
        branches, values = [], []
        for n, c in enumerate(used):
            cases = []
            for at, (own, _, lo, hi, _, by_size) in enumerate(ranges):
                if own == c:
                    part = _part(f"_x{n}", lo, hi, parts, by_size)
                    cases.append(f"WHEN _x{n} BETWEEN {_double(lo)} AND {_double(hi)} THEN {at * parts}L + {part}")
            values += [_number(c, types[c]).alias(f"_x{n}")]
            branches.append((f"CASE {' '.join(cases)} END AS _p{n}", f"(_p{n}, _q{n}) AS `{n}`", f"if(_p{n} IS NULL, NULL, _x{n}) AS _q{n}"))
        source = df.select(*values).selectExpr("*", *[b[0] for b in branches]).selectExpr("*", *[b[2] for b in branches])
        cells = df.sparkSession.sql(
            f"SELECT p, x FROM {{numbers}} UNPIVOT INCLUDE NULLS ((p, x) FOR c IN ({', '.join(b[1] for b in branches)})) WHERE p IS NOT NULL",
            numbers=source)
        counted = cells.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        by_range: dict[int, list] = {}
        for r in sorted(counted, key=lambda r: r["p"]):
            by_range.setdefault(r["p"] // parts, []).append(r)
        narrowed = []
        for at, (c, below, _, _, positions, _) in enumerate(ranges):
            left, total = list(positions), sum(r["n"] for r in by_range[at])
            for r in by_range[at]:
                own = [p for p in left if p < below + r["n"]]
                if own:
                    narrowed.append((c, below, r["lo"], r["hi"], own, 16 * r["n"] > total))
                    left = left[len(own) :]
                below += r["n"]
        ranges = narrowed
    return found


def _quantiles(df: DataFrame, stats: dict[str, tuple], probs: Sequence[float]) -> dict[str, list[float]]:
    """{column: its quantiles} for columns with values, from their :func:`_bounds`."""
    places = {c: [(n - 1) * p for p in probs] for c, (n, *_) in stats.items() if n}
    wanted, bounds = {}, {}
    for c, hs in places.items():
        n, low, high, lo, hi, _ = stats[c]
        bounds[c] = (low, lo, hi)
        wanted[c] = {i for h in hs for i in (math.floor(h), math.ceil(h)) if low <= i < n - high}
    found = _selected(df, [*wanted], bounds, wanted)

    def at(c: str, i: int) -> float:
        n, low, high, *_ = stats[c]
        return -math.inf if i < low else math.inf if i >= n - high else found[c, i]

    def between(c: str, h: float) -> float:
        a, b = at(c, math.floor(h)), at(c, math.ceil(h))
        return a if a == b else a + (h - math.floor(h)) * (b - a)

    return {c: [between(c, h) for h in hs] for c, hs in places.items()}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas ``describe``).

    -> column_name, prob, value (DOUBLE); columns without a value have no rows. For ``n`` non-NULL values the
    quantile ``p`` sits at 0-based position ``h = (n - 1) p`` between the values at ``floor(h)`` and ``ceil(h)``.

    One global aggregate gives counts and bounds; then a few passes narrow histograms around all positions of all
    columns together (:func:`_selected`). A pass shuffles at most ``HISTOGRAM_ROWS`` rows per map task, whatever
    the input; no values are sorted, written or gathered. Prices or quantities take two or three passes.
    """
    row = _bounds(df, cols)
    stats = {c: row[6 * n : 6 * n + 6] for n, c in enumerate(cols)}
    rows = [(c, float(p), v) for c, vs in _quantiles(df, stats, probs).items() for p, v in zip(probs, vs, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")


def data_snapshot(df: DataFrame, top_k: int = 3) -> DataFrame:
    """One summary row per column.

    -> attribute, dtype, row_count, non_null_ct, null_ct, distinct_ct, details

    ``details``: numeric columns (booleans excluded) give min / median / mean /
    max / P90 / P95 with two decimals; timestamps give min and max; every
    other column its ``top_k`` values with their share of non-NULL rows.
    ``dtype`` is Spark's type name. NaN is no value.

    One global aggregate gives counts, bounds and means, the narrowing histograms the quantiles (one row, and a
    bounded histogram a pass, come to the driver); the value-frequency table, counted but not written, gives distinct
    counts and top values.
    """
    spark, cols = df.sparkSession, list(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in cols if _is_numeric(types[c])]
    stamps = [c for c in cols if _is_datetime(types[c])]
    other = [c for c in cols if c not in numeric and c not in stamps]
    schema = ("attribute string, dtype string, row_count bigint, non_null_ct bigint, null_ct bigint, distinct_ct bigint, details string")
    if not cols:
        return spark.createDataFrame([], schema)
    extra = [F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in (*stamps, *other)],
             *[f(F.col(f"`{c}`")).cast("string") for c in stamps for f in (F.min, F.max)]]
    row = _bounds(df, numeric, extra)
    total, given = row[0], dict(zip((*stamps, *other), row[1:], strict=False))
    span = {c: row[1 + len(given) + 2 * n : 3 + len(given) + 2 * n] for n, c in enumerate(stamps)}
    stats = {c: row[len(extra) + 6 * n : len(extra) + 6 * n + 6] for n, c in enumerate(numeric)}
    given |= {c: x[0] for c, x in stats.items()}
    quantiles = _quantiles(df, stats, SNAPSHOT_QUANTILES)

    def details(c: str) -> str | None:
        if c in span:
            lo, hi = (x if x is not None else "NaT" for x in span[c])
            return f"Min: {lo}, Max: {hi}"
        if c not in stats:
            return None
        n, low, high, lo, hi, sum_ = stats[c]
        nan = float("nan")
        mn, mx = (-math.inf if low else lo if lo is not None else math.inf), (math.inf if high else hi if hi is not None else -math.inf)
        q = quantiles.get(c, [nan] * 3)
        named = zip(("Min", "Med", "Mean", "Max", "P90", "P95"),
                    (mn, q[0], sum_ / n, mx, q[1], q[2]) if n else [nan] * 6, strict=True)
        return ", ".join(f"{k}: {v:.2f}" for k, v in named)

    told = spark.createDataFrame(
        [(c, types[c].simpleString(), total, given[c], total - given[c], str(n), details(c)) for n, c in enumerate(cols)],
        "attribute string, dtype string, row_count bigint, non_null_ct bigint, null_ct bigint, c string, details string")
    freq = _typed_frequencies(df, cols)
    distinct = freq.groupBy("c").agg(F.count(F.lit(1)).alias("distinct_ct"))
    out = told.join(F.broadcast(distinct), "c", "left")  # a row a column
    if other:
        order = Window.partitionBy("c").orderBy(F.col("count").desc(), F.col("value").asc())
        text = freq.where(F.col("c").isin([str(cols.index(c)) for c in other])).select("c", "count", _text(df, cols).alias("value"))
        top = text.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
        top = top.join(F.broadcast(told.select("c", "non_null_ct")), "c")
        share = F.col("count").cast("double") / F.col("non_null_ct") * F.lit(100.0)
        item = F.concat(F.col("value"), F.lit(" ("), py_fixed(share, 1), F.lit("%)"))
        listed = top.groupBy("c").agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), item.alias("s")))), lambda x: x["s"]), ", ").alias("_list"))
        out = out.join(F.broadcast(listed), "c", "left")
        filled = F.coalesce(F.col("details"), F.concat(F.lit(f"Top {top_k}: "), F.coalesce("_list", F.lit(""))))
    else:
        filled = F.col("details")
    return out.select(
        "attribute", "dtype", "row_count", "non_null_ct", "null_ct",
        F.coalesce("distinct_ct", F.lit(0)).cast("bigint").alias("distinct_ct"), filled.alias("details"))


def top_n_values_with_excluded(df: DataFrame, cols: Sequence[str], top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """J36 in the reference's shape: (top values, all-NULL columns that were excluded)."""
    return top_n_values(df, cols, top_n), all_null_columns(df, cols)


def unique_values_with_excluded(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """J35 in the reference's shape: (distinct values, all-NULL columns that were excluded)."""
    return unique_values(df, cols), all_null_columns(df, cols)
