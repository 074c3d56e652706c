import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fraudstream.session import get_session

    s = get_session(
        "local[*]",
        shuffle_partitions=8,
        extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: the cluster names its own
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fraudstream-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="fraudstream-test-")
