import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import get_session
    scratch = tempfile.mkdtemp(prefix="shelfwise-test-")
    s = get_session("local[4]", shuffle_partitions=4, extra={"spark.local.dir": scratch,
                                                             "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="shelfwise-t-")
