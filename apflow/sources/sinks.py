"""Sinks. The reference's only sink is create-or-replace-table-as-select.

Nothing live is touched before the new rows are written whole: where the
catalog cannot replace a table atomically, and for plain folders, the rows go
to a staging name first, which then takes the live one's place in two renames.
A run that is lost while writing leaves the live data as it was. One lost
between the two renames leaves no live copy but both others under names that
carry the run's id; :func:`recover_table` and :func:`recover_parquet`, which every
replacement calls first, then finish the second rename, or undo the first
where the staged rows are not whole. A run lost before its last step leaves the
retired rows, which they delete. One writer at a time may replace a target.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SESSION_CATALOG = "spark_catalog"


def _replaces_atomically(spark: SparkSession, table: str) -> bool:
    """Whether the table's catalog is a v2 catalog; the built-in session catalog is not."""
    parts = table.split(".")
    catalog = parts[0] if len(parts) > 2 else spark.catalog.currentCatalog()
    return catalog != SESSION_CATALOG or spark.conf.get(f"spark.sql.catalog.{SESSION_CATALOG}", None) is not None


def replace_table(
    df: DataFrame, table: str, fmt: str = "parquet", buckets: int | None = None, bucket_by: Sequence[str] = ()
) -> None:
    """Create or replace a catalog table with the rows of ``df``.

    One ``createOrReplace`` on v2 catalogs (Iceberg, Delta); write, rename, drop
    on the built-in one. ``buckets`` (built-in catalog only) writes
    buckets over ``bucket_by``, each sorted by it.
    """
    spark = df.sparkSession
    if not buckets and _replaces_atomically(spark, table):
        df.writeTo(table).using(fmt).createOrReplace()
        return
    recover_table(spark, table)
    staged, retired = _names(table, uuid.uuid4().hex)
    writer = df.write.mode("errorifexists").format(fmt)
    if buckets:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(staged)
    existed = spark.catalog.tableExists(table)
    if existed:
        _rename_table(spark, table, retired)
    _rename_table(spark, staged, table)
    if existed:
        spark.sql(f"DROP TABLE {retired}")


def recover_table(spark: SparkSession, table: str) -> str:
    """Finish or undo a replacement of ``table`` that was lost between its steps (see :func:`recover_parquet`).

    A staged table of the catalog is whole: Spark enters it after its rows are written.
    """
    space, _, name = table.rpartition(".")
    found = spark.sql(f"SHOW TABLES {f'IN {space} ' if space else ''}LIKE '{name}_*'").collect()
    runs = _runs(name, [r["tableName"] for r in found])
    prefix = f"{space}." if space else ""
    if spark.catalog.tableExists(table):
        for run, kinds in runs.items():
            if kinds == {"old"}:
                spark.sql(f"DROP TABLE IF EXISTS {prefix}{name}_old_{run}")
        return "live"
    for run, kinds in runs.items():
        if "old" in kinds:
            staged, retired = _names(f"{prefix}{name}", run)
            _rename_table(spark, staged if "new" in kinds else retired, table)
            if "new" not in kinds:
                return "undone"
            spark.sql(f"DROP TABLE IF EXISTS {retired}")
            return "completed"
    return "absent"


def _names(target: str, run: str) -> tuple[str, str]:
    return f"{target}_new_{run}", f"{target}_old_{run}"


def _runs(name: str, others: Sequence[str]) -> dict[str, set[str]]:
    """{run id: which of its staged (new) and retired (old) copies are there}."""
    out: dict[str, set[str]] = {}
    for other in others:
        m = re.fullmatch(re.escape(name) + r"_(new|old)_([0-9a-f]{32})", other, re.IGNORECASE)
        if m:
            out.setdefault(m[2], set()).add(m[1].lower())
    return out


def _rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")


def _rename_folder(fs, old, new) -> None:
    if not fs.rename(old, new):
        raise OSError(f"cannot rename {old} to {new}")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_parquet(df: DataFrame, path: str) -> None:
    """Create or replace a parquet folder on shared storage."""
    spark, path = df.sparkSession, path.rstrip("/")
    recover_parquet(spark, path)
    live, fs = _folder(spark, path)
    staged, retired = (_folder(spark, name)[0] for name in _names(path, uuid.uuid4().hex))
    df.write.mode("errorifexists").parquet(staged.toString())
    existed = fs.exists(live)
    if existed:
        _rename_folder(fs, live, retired)
    _rename_folder(fs, staged, live)
    if existed:
        fs.delete(retired, True)


def recover_parquet(spark: SparkSession, path: str) -> str:
    """Finish or undo a replacement of ``path`` that was lost between its steps.

    * ``live``: the live folder is there; retired copies of finished replacements are deleted.
    * ``completed``: it was not, and the staged rows, which are whole (Spark's success marker), took its place.
    * ``undone``: it was not, there are no whole staged rows, and the retired ones are live again.
    * ``absent``: there is nothing to go by.
    """
    path = path.rstrip("/")
    live, fs = _folder(spark, path)
    parent = live.getParent()
    siblings = [s.getPath().getName() for s in fs.listStatus(parent)] if parent is not None and fs.exists(parent) else []
    runs = _runs(live.getName(), siblings)
    if fs.exists(live):
        for run, kinds in runs.items():
            if kinds == {"old"}:
                fs.delete(_folder(spark, _names(path, run)[1])[0], True)
        return "live"
    for run, kinds in runs.items():
        if "old" in kinds:
            staged, retired = (_folder(spark, name)[0] for name in _names(path, run))
            whole = "new" in kinds and fs.exists(_folder(spark, f"{staged.toString()}/_SUCCESS")[0])
            _rename_folder(fs, staged if whole else retired, live)
            if whole:
                fs.delete(retired, True)
            return "completed" if whole else "undone"
    return "absent"
