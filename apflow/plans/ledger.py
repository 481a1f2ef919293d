"""Ledger repair as the reference runs it: de-duplicate a backup copy into the live table."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame

from apflow.operators.invoices import dedupe_ledger, repair_control_totals
from apflow.sources.sinks import replace_parquet, replace_table


def repair_ledger(backup: DataFrame, target: str, to_path: bool = False, buckets: int | None = None) -> DataFrame:
    """J23 end to end: write the de-duplicated ``backup`` to ``target`` and
    return the per-month control totals (rows and amounts before and after).

    ``target`` is a catalog table name, or a parquet folder with
    ``to_path=True``. The source is a different table than the target, as in
    the reference; a backup read from the target folder, or from the
    target table, is refused.

    ``buckets`` writes the catalog table bucketed and sorted by invoice number.
    Every reconciliation job first counts ledger rows per invoice number; on a
    bucketed ledger that aggregate reads co-located buckets and the ledger is
    never shuffled again, run after run.
    """
    repaired = dedupe_ledger(backup)
    spark = backup.sparkSession
    if buckets and to_path:
        raise ValueError("bucketing needs a catalog table, not a path")
    if to_path:
        _refuse_own_files(backup, target)
        replace_parquet(repaired, target)
        return repair_control_totals(backup, spark.read.parquet(target))
    if spark.catalog.tableExists(target):
        _refuse_own_files(backup, *spark.table(target).inputFiles()[:1])
    replace_table(repaired, target, buckets=buckets, bucket_by=["invoice__"])
    return repair_control_totals(backup, spark.table(target))


def _refuse_own_files(backup: DataFrame, *target: str) -> None:
    """The driver holds the file list of a scan already, so comparing names reads nothing."""
    paths = [unquote(urlparse(x).path).rstrip("/") for x in target]
    for file in backup.inputFiles():
        name = unquote(urlparse(file).path)
        if any(name == p or name.startswith(p + "/") for p in paths):
            raise ValueError(f"the backup reads {target[0]}, which the repair would replace")
