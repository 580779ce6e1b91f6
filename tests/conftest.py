import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hitweave.session import build_session, clear_shared

    s = build_session("local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear_shared(s)
    s.stop()
