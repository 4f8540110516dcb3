import pytest

from groundspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4)
    yield session
    session.stop()
