import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
# Scripted models of the tests have to be importable in Python workers.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session(4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    # Entry points set this; tests also call operators directly.
    s.conf.set("spark.sql.unionOutputPartitioning", "false")
    return s


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def rows(df, *columns):
    """Sorted tuples of the given columns."""
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
