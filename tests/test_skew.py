"""A third of all rows on one key: results stay exact when AQE splits the hot partition."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from apflow.operators.invoices import dedupe_invoices, dedupe_ledger
from apflow.plans import payables, reconcile
from oracles import params as P
from tests.conftest import MEDIUM


@pytest.fixture()
def skew_conf(spark):
    keys = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _data(spark, n=3000):
    hot = "INV-HOT"
    headers = [
        (i, hot if i % 3 == 0 else (None if i % 11 == 0 else f"INV-{i}"), i % 7, Decimal(i % 100), dt.date(2025, 1, 1))
        for i in range(n)
    ]
    h = spark.createDataFrame(headers, "id long, invoice_number string, supplier_id long, gross_total decimal(18,2), "
                                       "payment_date date").repartition(8)
    ledger = [(hot if j % 2 == 0 else f"INV-{j}", f"S{j % 5}", dt.date(2025, 1, 1), j % 3, Decimal(j % 9),
               dt.date(2025, 1, 1), "x", dt.date(2025, 1, 2), dt.date(2025, 1, 3), dt.date(2025, 1, 4)) for j in range(600)]
    led = spark.createDataFrame(ledger, "invoice__ string, supplier string, payment_date date, requester long, "
                                        "total_usd decimal(18,2), invoice_date date, supplier__ string, "
                                        "created_date date, invoice_received_date date, net_due_date date")
    return h, led


def test_dedupe_hot_number(spark, skew_conf):
    h, _ = _data(spark)
    got = {r.invoice_number: r.id for r in dedupe_invoices(h).collect()}
    pdf = h.toPandas()
    pdf["k"] = pdf["invoice_number"].fillna("<null>")
    want = pdf.sort_values(["gross_total", "id"], ascending=[False, True]).groupby("k").head(1)
    assert got == {(None if k == "<null>" else k): i for k, i in zip(want["k"], want["id"])}


def test_match_counts_hot_number(spark, skew_conf):
    h, led = _data(spark)
    ledger = dedupe_ledger(led)
    fast = reconcile.with_match_count(h, ledger).groupBy("supplier_id").agg(
        F.sum(F.coalesce("_k", F.lit(1))).alias("t"), F.sum(F.coalesce("_k", F.lit(0))).alias("b")
    )
    naive = h.join(ledger, h.invoice_number == ledger.invoice__, "left").groupBy("supplier_id").agg(
        F.count("*").alias("t"), F.count("invoice__").alias("b")
    )
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, naive.collect()))


def test_match_counts_let_a_hot_number_be_split(spark):
    """A third of the invoices with one number: the final plan splits the join's hot partition."""
    from pyspark.sql import functions as F

    from apflow.plans.reconcile import with_match_count, without_match

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        number = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id")))
        invoices = spark.range(200_000).repartition(8).select("id", number.alias("invoice_number"), F.md5(F.col("id").cast("string")).alias("pad"))
        ledger = spark.range(20_000).select(F.concat(F.lit("n"), F.col("id")).alias("invoice__")).unionByName(
            spark.range(2).select(F.lit("hot").alias("invoice__")))
        out = with_match_count(invoices, ledger)
        rows = out.collect()
        assert len(rows) == 200_000 and sum(r["_k"] == 2 for r in rows) == 66_667
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        missing = without_match(invoices, ledger)
        rows = missing.collect()
        kept = {i for i in range(20_000, 200_000) if i % 3}
        assert {r["id"] for r in rows} == kept and len(rows) == len(kept)
        assert "skew=true" in missing._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture()
def split_conf(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_supplier(spark):
    """The AP tables with a third of the invoices on one supplier."""
    from apflow.sources.fixtures import APTables

    headers = APTables(spark, MEDIUM).invoice_header
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("supplier_id")).cast(headers.schema["supplier_id"].dataType)
    return APTables(spark, MEDIUM, tables={"invoice_header": headers.withColumn("supplier_id", hot).repartition(8)})


def _final_joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    return [line for line in plan.splitlines() if "SortMergeJoin" in line]


def test_supplier_chain_lets_a_hot_supplier_be_split(spark, split_conf):
    """J12 joins two lookups on the supplier one after the other; both split a hot one, and the rows stay the same."""
    spec = payables.FactSpec(P.START, P.END)
    fact = payables.invoice_fact(_hot_supplier(spark), spec)
    rows = fact.collect()
    by_supplier = [j for j in _final_joins(fact) if "[supplier_id" in j]
    assert len(by_supplier) == 2 and all("skew=true" in j for j in by_supplier), by_supplier
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        whole = payables.invoice_fact(_hot_supplier(spark), spec).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    assert sorted(map(str, rows)) == sorted(map(str, whole))


def test_tier_chain_lets_a_hot_supplier_be_split(spark, split_conf):
    """The supplier, its tier and the match count; the two supplier joins split a hot supplier."""
    t = _hot_supplier(spark)
    tiers = reconcile.coverage_by_tier(t, P.START, P.END, t.ledger_period(P.START, P.END))
    total = sum(r["total_count"] for r in tiers.collect())
    joins = [j for j in _final_joins(tiers) if "[_bid#" in j]
    assert len(joins) == 2 and all("skew=true" in j for j in joins), joins
    assert total > 0
