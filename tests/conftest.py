import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from airlag.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app="airlag-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle import duck
    return duck(SF_SMALL)
