import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from matchbook.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def duck0001():
    from harness import duck
    return duck(SF0001)
