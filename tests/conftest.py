import os
import sys

import pytest
from pyspark import cloudpickle

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from proofdesk.session import build_session
    s = build_session("proofdesk-tests", "local[8]", 8, spark__ui__enabled="false", spark__driver__memory="8g",
                      spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(autouse=True, scope="module")
def stand_ins_travel_by_value(request):
    """Workers cannot import test modules, so the stand-ins defined there are sent along."""
    cloudpickle.register_pickle_by_value(request.module)
