import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from apflow.session import get_session

    scratch = tempfile.mkdtemp(prefix="apflow-tests-")
    s = get_session(
        "apflow-tests",
        master="local[4]",
        shuffle_partitions=8,
        # spark.checkpoint.dir is taken from the session (spark-defaults); get_session
        # sets a scratch one only when it is unset
        extra_conf={
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    from apflow.operators.joins import clear_intermediates

    clear_intermediates(s)


@pytest.fixture(scope="session")
def tables(spark):
    from apflow.sources.fixtures import APTables

    return APTables(spark, SMALL)
