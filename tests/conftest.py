import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablescope.session import local_session  # noqa: E402
from tablescope.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def t(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def quality(spark):
    """Five rows: a missing value, a repeated row, an outlier."""
    # The test table whose results are known.
    rows = [
        (25, 50000.0, 1, "New York"),
        (30, 60000.0, 0, "Chicago"),
        (35, None, 1, "New York"),
        (30, 60000.0, 0, "Chicago"),
        (120, 200000.0, 1, "Miami"),
    ]
    return spark.createDataFrame(rows, "Age bigint, Salary double, Target bigint, City string")
