import pytest

from parley import session


@pytest.fixture(scope="session")
def spark():
    return session.local("8", "4")
