import pytest

from caseloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", "4", shuffle=4, memory="8g")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()
