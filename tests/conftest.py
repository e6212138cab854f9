"""One local session for all tests."""

import os
import tempfile

import pytest

from tidemark.session import session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    found = session("tests", f"local[{os.environ.get('TEST_CPUS', '8')}]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tidemark-tests-"),
    })
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
