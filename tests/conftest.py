import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from viewpoint.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="viewpoint-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    if not os.path.exists(SMALL):
        pytest.skip("test data missing")
    return SMALL
