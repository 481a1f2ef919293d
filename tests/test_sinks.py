import os
import tempfile

import pytest

from apflow.operators.invoices import dedupe_ledger
from apflow.sources.sinks import replace_parquet, replace_table


def test_replace_parquet_and_table(spark, tables):
    repaired = dedupe_ledger(tables.ledger_backup)
    n = repaired.count()
    path = os.path.join(tempfile.mkdtemp(prefix="apflow-sink-"), "ledger")
    replace_parquet(repaired, path)
    replace_parquet(repaired, path)  # overwrite, not append
    assert spark.read.parquet(path).count() == n
    replace_table(repaired, "ledger_repaired")
    replace_table(repaired, "ledger_repaired")
    assert spark.table("ledger_repaired").count() == n


def test_repair_ledger_writes_table_and_reports_totals(spark, tables):
    from pyspark.sql import functions as F

    from apflow.plans.ledger import repair_ledger

    path = os.path.join(tempfile.mkdtemp(prefix="apflow-repair-"), "ledger")
    totals = repair_ledger(tables.ledger_backup, path, to_path=True)
    written = spark.read.parquet(path)
    assert written.count() == tables.ledger.count()
    agg = totals.agg(F.sum("rows_before"), F.sum("rows_after"), F.sum("rows_removed")).first()
    assert agg[0] == tables.ledger_backup.count() and agg[1] == written.count() and agg[0] - agg[1] == agg[2]


def test_bucketed_ledger_needs_no_shuffle_for_match_counts(spark, tables):
    from apflow.plans.ledger import repair_ledger
    from apflow.plans.reconcile import ledger_match_counts

    totals = repair_ledger(tables.ledger_backup, "ledger_bucketed", buckets=4)
    assert totals.count() > 0
    ledger = spark.table("ledger_bucketed")
    assert ledger.count() == tables.ledger.count()
    plan = ledger_match_counts(ledger)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan, plan


def test_replacing_leaves_no_other_copy(spark, tables):
    folder = tempfile.mkdtemp(prefix="apflow-sink-")
    path = os.path.join(folder, "t")
    for n in (3, 5):
        replace_parquet(spark.range(n), path)
        replace_table(spark.range(n), "replaced_twice")
        assert spark.read.parquet(path).count() == n and spark.table("replaced_twice").count() == n
    assert os.listdir(folder) == ["t"]
    assert [t.name for t in spark.catalog.listTables() if "replaced_twice" in t.name] == ["replaced_twice"]


def test_a_failed_write_leaves_the_live_rows(spark):
    from pyspark.sql import functions as F

    path = os.path.join(tempfile.mkdtemp(prefix="apflow-sink-"), "t")
    replace_parquet(spark.range(4), path)
    bad = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        replace_parquet(bad, path)
    assert spark.read.parquet(path).count() == 4


class Lost(Exception):
    """The driver is gone."""


def _lose_after(monkeypatch, sinks, name, renames):
    """Let the process end after so many renames."""
    left, real = [renames], getattr(sinks, name)

    def stop(*a):
        if not left[0]:
            raise Lost
        left[0] -= 1
        real(*a)

    monkeypatch.setattr(sinks, name, stop)


def _replace_and_lose(monkeypatch, write, sinks, name, renames):
    with monkeypatch.context() as m:
        _lose_after(m, sinks, name, renames)
        with pytest.raises(Lost):
            write()


def test_a_replacement_lost_between_the_renames_is_completed(spark, monkeypatch):
    from apflow.sources import sinks

    folder = tempfile.mkdtemp(prefix="apflow-sink-")
    path = os.path.join(folder, "t")
    replace_parquet(spark.range(3), path)
    _replace_and_lose(monkeypatch, lambda: replace_parquet(spark.range(7), path), sinks, "_rename_folder", 1)
    assert not os.path.exists(path)
    assert sinks.recover_parquet(spark, path) == "completed"
    assert spark.read.parquet(path).count() == 7 and os.listdir(folder) == ["t"]
    assert sinks.recover_parquet(spark, path) == "live"

    replace_table(spark.range(3), "lost_between")
    _replace_and_lose(monkeypatch, lambda: replace_table(spark.range(7), "lost_between"), sinks, "_rename_table", 1)
    assert not spark.catalog.tableExists("lost_between")
    assert sinks.recover_table(spark, "default.lost_between") == "completed"
    assert spark.table("lost_between").count() == 7
    assert [t.name for t in spark.catalog.listTables() if "lost_between" in t.name] == ["lost_between"]
    assert sinks.recover_table(spark, "lost_between") == "live"


def test_the_next_replacement_starts_from_a_live_copy(spark, monkeypatch):
    from apflow.sources import sinks

    folder = tempfile.mkdtemp(prefix="apflow-sink-")
    path = os.path.join(folder, "t")
    replace_parquet(spark.range(3), path)
    replace_table(spark.range(3), "lost_again")
    for write, name in ((lambda n: replace_parquet(spark.range(n), path), "_rename_folder"),
                        (lambda n: replace_table(spark.range(n), "lost_again"), "_rename_table")):
        _replace_and_lose(monkeypatch, lambda: write(7), sinks, name, 1)
        _replace_and_lose(monkeypatch, lambda: write(8), sinks, name, 1)  # its recovery needs the one rename it gets
        write(9)
    assert spark.read.parquet(path).count() == 9 and spark.table("lost_again").count() == 9


def test_a_retired_copy_without_whole_staged_rows_comes_back(spark):
    from apflow.sources import sinks

    folder = tempfile.mkdtemp(prefix="apflow-sink-")
    path, run = os.path.join(folder, "t"), "0" * 32
    spark.range(4).write.parquet(f"{path}_old_{run}")
    os.makedirs(f"{path}_new_{run}")  # no success marker
    assert sinks.recover_parquet(spark, path) == "undone"
    assert spark.read.parquet(path).count() == 4
    spark.range(5).write.saveAsTable(f"came_back_old_{run}")
    assert sinks.recover_table(spark, "came_back") == "undone" and spark.table("came_back").count() == 5


def test_recovery_leaves_other_names_alone(spark):
    from apflow.sources import sinks

    folder = tempfile.mkdtemp(prefix="apflow-sink-")
    path, run = os.path.join(folder, "t"), "a" * 32
    names = [f"t_old_{run}", f"tt_old_{run}", "t_old_notes", f"t_new_{'b' * 32}"]
    for name in names:
        spark.range(1).write.parquet(os.path.join(folder, name))
    spark.range(2).write.parquet(path)
    assert sinks.recover_parquet(spark, path) == "live"
    # the retired copy of a finished run goes; a staged one may belong to a run that is still writing
    assert sorted(os.listdir(folder)) == sorted(["t", *names[1:]])
    assert sinks.recover_parquet(spark, os.path.join(folder, "nothing")) == "absent"
    assert sinks.recover_parquet(spark, os.path.join(folder, "no", "such")) == "absent"
    assert sinks.recover_table(spark, "no_such_table") == "absent"


def test_repair_refuses_a_backup_that_is_the_target(spark, tables):
    from apflow.plans.ledger import repair_ledger

    path = os.path.join(tempfile.mkdtemp(prefix="apflow-repair-"), "ledger")
    replace_parquet(tables.ledger_backup, path)
    with pytest.raises(ValueError, match="would replace"):
        repair_ledger(spark.read.parquet(path), path, to_path=True)
    replace_table(tables.ledger_backup, "own_backup")
    with pytest.raises(ValueError, match="would replace"):
        repair_ledger(spark.table("own_backup"), "own_backup")


def test_written_intermediates_can_be_cleared(spark, monkeypatch):
    from apflow.operators import joins

    folder = os.path.join(tempfile.mkdtemp(prefix="apflow-written-"), "tables")
    monkeypatch.setattr(joins, "_intermediates", lambda _: folder)
    assert joins.materialize(spark.range(3)).count() == 3
    assert len(os.listdir(folder)) == 1
    joins.clear_intermediates(spark)
    assert not os.path.exists(folder)
    joins.clear_intermediates(spark)  # nothing to delete is no error
    assert joins.materialize(spark.range(2)).count() == 2
