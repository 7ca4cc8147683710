import pytest

from tests.conftest import DATA


@pytest.fixture(scope="session")
def data():
    return DATA
