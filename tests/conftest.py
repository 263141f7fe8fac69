import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidesync.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("TIDESYNC_TEST_SF", SF_SMALL)


@pytest.fixture(scope="session")
def spark():
    s = local_session("local[*]", 8)
    yield s
    s.stop()
