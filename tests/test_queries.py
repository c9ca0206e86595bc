"""Every query that has SQL gives the SQL's rows; the others give rows of a stable schema."""

import pytest

from compare import database, differences
from minewright.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_equal_sql(spark, con, name):
    assert differences(registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()) is None
