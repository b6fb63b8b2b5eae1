import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from talkloom.session import build_session

    shared = "file://" + str(tmp_path_factory.mktemp("shared"))
    session = build_session("tests", cpus=4, shuffle_partitions=4, driver_memory="4g", extra={"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
