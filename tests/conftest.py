import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rainloom.session import local_session

    s = local_session("rainloom-tests", cores=8, partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
