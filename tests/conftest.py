import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from lurelog.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    return local_session(8, "lurelog-tests", str(tmp_path_factory.mktemp("staging")))


@pytest.fixture
def lines(spark):
    def build(*texts):
        return spark.createDataFrame([("f", t) for t in texts], "file STRING, value STRING")

    return build
