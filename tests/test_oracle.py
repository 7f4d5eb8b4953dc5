"""Every registered query beside its SQL on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from weft.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
