"""Lookups written once and shared by the jobs over one set of tables."""

from pyspark.sql import functions as F

from apflow.operators import joins
from apflow.operators.rates import monthly_rates
from apflow.plans import payables, reconcile
from apflow.sources.fixtures import APTables
from oracles import params as P
from tests.conftest import SMALL


def _count_writes(monkeypatch):
    paths, real = [], joins._write
    monkeypatch.setattr(joins, "_write", lambda df, path, small: (paths.append(path), real(df, path, small))[1])
    return paths


def test_equal_plans_share_a_table_and_others_do_not(spark, monkeypatch):
    paths, store = _count_writes(monkeypatch), joins.WrittenTables()
    t = APTables(spark, SMALL)
    a, rows = store.get(monthly_rates(t.exchange_rate, 1, P.RATES_SINCE))
    b, again = store.get(monthly_rates(t.exchange_rate, 1, P.RATES_SINCE))
    assert len(paths) == 1 and rows == again == a.count() and a is b
    c, other = store.get(monthly_rates(t.exchange_rate, 2, P.RATES_SINCE))
    assert len(paths) == 2 and other != rows
    assert sorted(map(tuple, c.collect())) == sorted(map(tuple, monthly_rates(t.exchange_rate, 2, P.RATES_SINCE).collect()))


def test_a_deleted_table_is_written_again(spark, monkeypatch):
    paths, store = _count_writes(monkeypatch), joins.WrittenTables()
    df = spark.range(5).select((F.col("id") * 3).alias("x"))
    assert store.get(df)[1] == 5
    folder = spark._jvm.org.apache.hadoop.fs.Path(paths[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    written, rows = store.get(df)
    assert rows == 5 and len(paths) == 2 and sorted(r.x for r in written.collect()) == [0, 3, 6, 9, 12]


def test_forget_reads_changed_sources(spark, tmp_path):
    path, store = str(tmp_path / "t"), joins.WrittenTables()
    spark.range(3).write.parquet(path)
    assert store.get(spark.read.parquet(path))[1] == 3
    spark.range(4).write.mode("append").parquet(path)
    assert store.get(spark.read.parquet(path))[1] == 3  # as it was when the table was written
    store.forget()
    assert store.get(spark.read.parquet(path))[1] == 7


def test_jobs_over_the_same_tables_write_each_lookup_once(spark, monkeypatch):
    paths = _count_writes(monkeypatch)
    t = APTables(spark, SMALL)

    def trend():
        metrics = reconcile.supplier_coverage(t.invoice_header, t.ledger, t.supplier_dim, P.START, P.END)
        problem = reconcile.problem_suppliers(metrics, P.MIN_PCT_MISSING, 40, written=t.written)
        spec = payables.FactSpec(P.START, P.END, since=P.RATES_SINCE, excluded_suppliers=problem, lookups=False)
        return payables.monthly_trend(payables.invoice_fact(t, spec))

    first = sorted(map(str, trend().collect()))
    assert len(paths) == 2  # the excluded suppliers and the rates
    assert sorted(map(str, trend().collect())) == first and len(paths) == 2
    reconcile.coverage_by(t, reconcile.REFERENCE_DIMENSIONS[12], P.START, P.END, t.ledger_period(P.START, P.END), amounts=True,
                          rates_since=P.RATES_SINCE).collect()
    assert len(paths) == 2  # the same rates
    assert len(APTables(spark, SMALL).written._held) == 0
