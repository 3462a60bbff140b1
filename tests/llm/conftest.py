import pytest

from omenlog.session import ship


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture
def folder():
    return "/root/testdata/sf0.001"
