import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quizspark.session import checkpoint_dir, get_session
    s = get_session(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s)
    yield s
