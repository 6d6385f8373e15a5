import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wordloom.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="wordloom-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wl-test-ckpt-"))
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="wl-test-")
