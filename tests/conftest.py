import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from coldwatch.session import local_session

    session = local_session(8, "coldwatch-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
