import pytest

from terravane.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4, shuffle_partitions=4, driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
