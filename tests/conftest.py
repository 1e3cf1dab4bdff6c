import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogspark.session import build_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", "tests", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="6g")
    s.sparkContext.setLogLevel("OFF")
    yield prepare(s)
    s.stop()
