import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lorekeep.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "4g")


@pytest.fixture
def rows(spark):
    """Build a DataFrame from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    return SMALL
