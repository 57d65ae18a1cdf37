import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recolake.session import build_session
    s = build_session("local[4]", shuffle_partitions=8, app_name="recolake-tests")
    yield s
    s.stop()


SMALL = "/root/testdata/sf0.001"
