import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from haulage.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="haulage-tests")
    ckpt = tempfile.mkdtemp(prefix="haulage-test-ckpt-", dir="/tmp")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(spark):
    from haulage.session import scratch_path
    return scratch_path(spark, "test")
