import pytest

from lexbolt.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", spark__sql__shuffle__partitions="4")
    s.sparkContext.setLogLevel("ERROR")
    return s
