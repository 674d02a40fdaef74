import pytest

from sieverank import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "sieverank-tests",
        spark__master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
