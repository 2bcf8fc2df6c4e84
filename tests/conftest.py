import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from evalspark.session import local_session
    s = local_session(2, shuffle_partitions=4, app="evalspark-tests")
    yield s
    s.stop()
