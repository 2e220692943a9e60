"""Every registered query against its SQL twin."""

import os

import pytest

import __spark_entry__ as driver
from checks.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", driver.queries())
def test_query(spark, db, name):
    assert compare(spark, db, name, SF_DIR) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_twins_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())
