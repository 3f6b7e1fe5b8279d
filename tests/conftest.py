import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tasteloom.session import local_session

    return local_session("4", "tasteloom-tests", "6g")


@pytest.fixture(scope="session")
def tables(spark):
    from tasteloom.tables import Tables

    return Tables(spark, "/root/testdata/sf0.001")
