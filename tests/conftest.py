import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventloom.plans.timeline import DEFAULT_MAX_ROWS, MAX_ROWS_CONF  # noqa: E402
from eventloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "sliced"])
def layout(request, spark):
    """Run a test with whole keys and with every key over two rows sliced."""
    spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS if request.param == "whole" else 2))
    yield request.param
    spark.conf.set(MAX_ROWS_CONF, str(DEFAULT_MAX_ROWS))
