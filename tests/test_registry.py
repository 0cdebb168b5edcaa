"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from strata.plans import registry
from tests.conftest import DATA, connect, same_rows

D = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(D)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, db, name):
    same_rows(registry.QUERIES[name](spark, D), db, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, D).count() >= 0
