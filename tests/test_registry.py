"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from tests.oracle import spark_rows, sql_rows

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == sql_rows(registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) ))
def test_gives_rows(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()  # every column is computed, which a count would leave out
    assert rows and len(rows[0]) > 1
