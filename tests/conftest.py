import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from echotrail.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", 4, spark__ui__enabled="false",
                            spark__ui__showConsoleProgress="false", spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from check_queries import connect

    return connect(SMALL)


@pytest.fixture()
def tiny_groups(spark):
    """Treat every group above three rows as hot, in a few slices, so the split path runs on small data."""
    from echotrail.operators import skew

    spark.conf.set(skew.HOT_ROWS_KEY, "3")
    spark.conf.set(skew.SLICE_ROWS_KEY, "2500")
    yield
    spark.conf.unset(skew.HOT_ROWS_KEY)
    spark.conf.unset(skew.SLICE_ROWS_KEY)
