import pytest

from pulsegrid.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
