import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from meterbook.session import build_session
    s = build_session("local[4]", 8, extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-"),
                                            "spark.driver.memory": "6g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.oracle_check import duck_con
    return duck_con(SMALL)


@pytest.fixture(scope="session")
def book(spark):
    from meterbook.sources.fixtures import Book
    return Book(spark, SMALL)
