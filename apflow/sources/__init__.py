"""Sources and sinks: the testdata reader, the canonical AP tables and table writers."""

from apflow.sources.fixtures import APTables
from apflow.sources.sinks import replace_parquet, replace_table
from apflow.sources.testdata import read_table

__all__ = ["APTables", "read_table", "replace_parquet", "replace_table"]
