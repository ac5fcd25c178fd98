"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from scripts.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, db, name):
    got = contract.queries()[name](spark, SF_DIR).toPandas()
    found = difference(got, db.execute(contract.oracle_sql()[name]).df())
    assert found is None


@pytest.mark.parametrize(
    "name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_has_rows(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0
