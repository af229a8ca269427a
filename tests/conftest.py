import os
import sys

# Test sessions share one machine with their workers: one thread a process for matrix routines.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidalgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("tidalgrid-tests", cores="4", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("TIDALGRID_TEST_DIR", "/root/testdata/sf0.001")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
