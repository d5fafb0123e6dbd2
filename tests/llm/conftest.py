import pytest

from . import helpers


@pytest.fixture
def odd(spark):
    return helpers.odd(spark)


@pytest.fixture
def empty(spark):
    return helpers.empty(spark)
