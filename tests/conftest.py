import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture(scope="session")
def spark():
    from quorumlake.session import local_session

    s = local_session("4", "tests", spark__sql__shuffle__partitions="4", spark__default__parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
