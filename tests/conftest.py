import pytest

from voxloom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
