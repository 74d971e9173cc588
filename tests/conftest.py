import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("logmill-tests", cpus=4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("test tables are not there")
    return path


@pytest.fixture
def lines(spark):
    """Make (file_id, line_no, line) from texts."""

    def make(*texts, file_id="f.log"):
        rows = [(file_id, no, text) for no, text in enumerate(texts, start=1)]
        return spark.createDataFrame(rows, "file_id string, line_no long, line string")

    return make
