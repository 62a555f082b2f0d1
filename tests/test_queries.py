"""Every registered query against its SQL in DuckDB."""

import oracle
import pytest

from siftlake import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert oracle.differences(spark, con, plans.QUERIES[name], plans.ORACLES[name], SF) == ""
