"""Tables of a repository scan that grow with the repositories are not broadcast, however small their files are."""

import pytest
from pyspark.sql import DataFrame

from siftlake.plans import QUERIES

SF = "/root/testdata/sf0.001"


def broadcast_joins(spark, monkeypatch, name):
    """Broadcast joins in each table that the query writes on its way, and in its result."""
    plans, write = [], DataFrame.write.fget
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def spy(df):
        plans.append(plan(df))
        return write(df)

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "write", property(spy))
        plans.append(plan(QUERIES[name](spark, SF)))
    return [p.count("BroadcastHashJoin") for p in plans]


@pytest.mark.parametrize("name", ["audit_context", "repository_scan"])
def test_scan_broadcasts_nothing_by_estimate(spark, monkeypatch, name):
    found = broadcast_joins(spark, monkeypatch, name)
    # what is left are hints: dimensions, and tables that a count shows to be small
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hinted = broadcast_joins(spark, monkeypatch, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == hinted
