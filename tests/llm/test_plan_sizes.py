"""Joins that Spark would broadcast by too low an estimate."""

import pytest
from pyspark.sql import functions as F

from siftlake.llm import simhash
from siftlake.storage import bounded, materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def default_bound(spark):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("10485760")


def test_replicas_of_fingerprints_are_not_broadcast(spark):
    nodes = materialize(spark.range(2000).select(F.xxhash64("id").alias("fp")))
    near = simhash.links(nodes)
    assert "BroadcastHashJoin" not in plan(near)
    assert near.count() == 0


def test_table_beyond_the_bound_is_not_broadcast(spark):
    # one value, so its file is small
    keys, rows = (materialize(spark.range(300).select((F.col("id") % n).alias("key"), F.lit("x" * 1000).alias("text"))) for n in (300, 7))
    for how, most, broadcast in (("inner", 100, False), ("left_semi", 100, False), ("left_anti", 300, True)):
        joined = rows.join(bounded(keys, most), "key", how)
        assert ("BroadcastHashJoin" in plan(joined)) == broadcast
        assert joined.count() == (0 if how == "left_anti" else 300)
