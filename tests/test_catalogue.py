"""Registered queries of the library against their SQL, and that the others run."""

import pytest

from dotfield.plans import catalogue
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
