"""NOT IN of any size, facts reduced by surviving keys, and joins to a hot many side."""

import pytest
from pyspark.sql import functions as F

from apflow.operators import joins
from apflow.operators.invoices import duplicate_audit, valid_invoices
from apflow.plans import payables, reconcile
from oracles import params as P
from tests.test_skew import _final_joins, skew_conf, split_conf  # noqa: F401


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------------------- NOT IN
@pytest.mark.parametrize("values", [[], [None], [1, 3], [1, None, 3], [7, 7, 8]])
def test_not_in_has_the_null_rules_of_sql(spark, values):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None), (5, 3)], "id int, k int")
    v = spark.createDataFrame([(x,) for x in values], "k int")  # a clashing name
    got = sorted(r.id for r in joins.where_not_in(df, "k", v).collect())
    df.createOrReplaceTempView("not_in_rows")
    v.createOrReplaceTempView("not_in_values")
    assert got == sorted(r.id for r in spark.sql("SELECT id FROM not_in_rows WHERE k NOT IN (SELECT k FROM not_in_values)").collect())


def test_not_in_of_a_million_values_needs_no_broadcast(spark, no_broadcast):
    values = spark.range(1_000_000).select((F.col("id") * 2).alias("v"))
    df = spark.range(300_000).select(F.when(F.col("id") % 11 != 0, F.col("id")).alias("k"))
    out = joins.where_not_in(df, "k", values)
    assert out.count() == sum(i % 11 != 0 and i % 2 == 1 for i in range(300_000))
    assert "Broadcast" not in _plan(out).replace("ReusedSubquery", "")
    assert joins.where_not_in(df, "k", values.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("v")))).count() == 0
    assert joins.where_not_in(df, "k", values.limit(0)).count() == 300_000


def test_not_in_lets_a_hot_value_be_split(spark, split_conf):
    hot = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id"))
    df = spark.range(60_000).repartition(8).select(hot.alias("k"), F.md5(F.col("id").cast("string")).alias("pad"))
    out = joins.where_not_in(df, "k", spark.range(1, 60_000, 2).select(F.col("id").alias("v")))
    rows = out.collect()
    assert len(rows) == sum(i % 3 == 0 or i % 2 == 0 for i in range(60_000))
    assert any("skew=true" in j for j in _final_joins(out))


def test_validity_rule_takes_excluded_suppliers_of_any_size(spark, tables, no_broadcast):
    h = tables.invoice_header
    many = spark.range(0, 200_000, 2).select(F.col("id").alias("supplier_id"))
    kept = valid_invoices(h, P.START, P.END, "loose", excluded_suppliers=many)
    plain = valid_invoices(h, P.START, P.END, "loose").where("supplier_id % 2 = 1")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in plain.collect())
    assert "BroadcastHashJoin" not in _plan(kept)


# ------------------------------------------------- facts reduced by keys
def test_reduction_keeps_every_row_of_a_key_and_drops_others(spark):
    fact = spark.range(20_000).select(F.when(F.col("id") % 13 != 0, F.col("id") % 2000).alias("k"), "id").withColumn("_word", F.lit(1))
    keys = joins.materialize(spark.range(0, 2000, 5).select("id").unionByName(spark.createDataFrame([(None,), (5,)], "id long")))
    want = sorted(r.id for r in fact.where("k % 5 = 0").collect())
    exact = joins.reduce_by_keys(fact.drop("_word"), "k", keys)
    assert sorted(r.id for r in exact.collect()) == want
    hashed = joins.reduce_by_keys(fact.drop("_word"), "k", keys, max_rows=0)
    assert hashed.columns == ["k", "id"]
    got = [r.id for r in hashed.collect()]
    assert set(want) <= set(got) and len(got) == len(set(got)) < len(want) * 1.1
    assert "BroadcastHashJoin" in _plan(hashed)
    assert joins.reduce_by_keys(fact, "k", keys, max_rows=0, max_bitmap_keys=1) is fact
    assert joins.reduce_by_keys(fact.drop("_word"), "k", joins.materialize(keys.limit(0)), max_rows=0).count() == 0


def test_reduction_by_text_keys(spark):
    fact = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("number"))
    keys = joins.materialize(spark.range(0, 5000, 10).select(F.concat(F.lit("n"), F.col("id")).alias("number")))
    assert 500 <= joins.reduce_by_keys(fact, "number", keys, max_rows=0).count() < 520


def _below(plan, exchange):
    """The subtree under the first exchange on ``exchange`` of the initial plan."""
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    start = next(i for i, line in enumerate(lines) if f"Exchange hashpartitioning({exchange}" in line)
    depth = len(lines[start]) - len(lines[start].lstrip(" :+-*("))
    out = []
    for line in lines[start + 1 :]:
        if len(line) - len(line.lstrip(" :+-*(")) <= depth:
            break
        out.append(line)
    return "\n".join(out)


def test_lines_of_other_headers_go_before_the_shuffle(spark, tables):
    import __spark_entry__ as E
    from tests.conftest import SMALL

    for name in ("j07_dedupe_with_line_currency", "j09_month_total_line_currency", "j12_enriched_invoices"):
        below = _below(_plan(E.queries()[name](spark, SMALL)), "invoice_header_id")
        assert "LeftSemi" in below and "BroadcastHashJoin" in below, name


# ------------------------------------------------------ a hot many side
def _sides(spark, n=9000):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 17 == 0, None).otherwise(F.concat(F.lit("n"), F.col("id") % 500))
    many = spark.range(n).repartition(6).select(key.alias("m_key"), F.col("id").alias("m_id"))
    one = spark.createDataFrame([("hot", 1), ("n1", 2), ("n2", 3), ("none", 4), (None, 5), ("n1", 6), ("hot", 7)], "o_key string, o_id int")
    return one, many


@pytest.mark.parametrize("rows_per_salt", [100, 1000, 10**6])
def test_salted_join_is_the_plain_left_join(spark, rows_per_salt):
    one, many = _sides(spark)
    got = joins.left_join_many(one, many, "o_key", "m_key", rows_per_salt=rows_per_salt)
    want = one.join(many, one.o_key == many.m_key, "left")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    nothing = joins.left_join_many(one, many.limit(0), "o_key", "m_key")
    assert nothing.count() == 7 and nothing.where("m_id is not null").count() == 0
    assert joins.left_join_many(one.limit(0), many, "o_key", "m_key").count() == 0


def test_salted_join_bounds_the_largest_task(spark, no_broadcast):
    one, many = _sides(spark, 60_000)  # 20,000 rows of one key
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.adaptive.skewJoin.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        for k in list(old)[1:]:
            spark.conf.set(k, "false")
        one = one.where("o_id in (1, 2)")

        def largest(df):
            return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]

        assert largest(one.join(many, one.o_key == many.m_key, "left")) >= 20_000
        assert largest(joins.left_join_many(one, many, "o_key", "m_key", rows_per_salt=500, max_rows=0)) < 4_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_side_by_side_with_a_third_of_the_ledger_on_one_number(spark, tables, monkeypatch):
    from apflow.sources.fixtures import APTables
    from tests.conftest import SMALL

    number = tables.invoice_header.where("document_type = 'Invoice' and status = 'APPROVED' and invoice_number is not null "
                                         "and payment_date is not null").first().invoice_number
    spread = F.when(F.crc32(F.col("supplier__").cast("binary")) % 3 == 0, F.lit(number)).otherwise(F.col("invoice__"))
    t = APTables(spark, SMALL, tables={"ledger": joins.materialize(tables.ledger.withColumn("invoice__", spread))})
    args = (t, P.START, P.END, P.RATES_SINCE, P.LEDGER_AFTER, P.BASE_CURRENCY)
    plain = sorted(map(str, reconcile.side_by_side(*args).collect()))
    salted = reconcile.left_join_many
    monkeypatch.setattr(reconcile, "left_join_many", lambda *a: salted(*a, rows_per_salt=20))
    got = reconcile.side_by_side(*args)
    assert sorted(map(str, got.collect())) == plain
    assert sum(number in r for r in plain) > 100


def test_duplicate_audit_lets_a_hot_number_be_split(spark, split_conf):
    number = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.floor(F.col("id") / 2)))
    day = F.lit("2025-01-01").cast("date")
    ledger = spark.range(60_000).repartition(8).select(
        number.alias("invoice__"), F.concat(F.lit("s"), F.col("id") % 5).alias("supplier"), F.lit("x").alias("supplier__"),
        day.alias("payment_date"), F.col("id").alias("requester"), (F.col("id") % 7).cast("decimal(18,2)").alias("total_usd"),
        day.alias("invoice_date"), day.alias("created_date"), day.alias("invoice_received_date"), day.alias("net_due_date"))
    audit = duplicate_audit(ledger, ("invoice__", "supplier"), "2024-01-01")
    assert audit.count() == 20_000
    rows = audit.select("invoice__").distinct()
    assert [r[0] for r in rows.collect()] == ["hot"]
    audit.collect()
    assert any("skew=true" in j for j in _final_joins(audit))
