import pytest

from skein.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, partitions=4)
    yield s
    s.stop()
