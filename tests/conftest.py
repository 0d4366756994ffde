import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from botsift.session import local_session

    s = local_session("*", app="botsift-tests")
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return SF_SMALL
