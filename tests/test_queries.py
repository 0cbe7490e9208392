"""Every registered query against its SQL on the small test data."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    return check.duck(SF)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    verdict, n = check.compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only")
    assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 8
