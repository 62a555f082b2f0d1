"""Floors of sums of doubles, which must not depend on how a table is split."""

import random

import duckdb
import oracle
import pyarrow as pa
import pyarrow.parquet as pq

from siftlake import plans


def star(folder, rnd):
    """Tables in which many customers' prices add up to a whole number, or to almost one, by their order; orders in many row groups."""
    rows = []
    for customer in range(200):
        cents = [rnd.randrange(10**7) for _ in range(8)]
        cents.append(-sum(cents) % 100 + 100 * rnd.randrange(10**5))
        rows += [(customer, c / 100) for c in cents]
    rnd.shuffle(rows)
    n = len(rows)
    pq.write_table(pa.table({"o_orderkey": list(range(n)), "o_custkey": [c for c, _ in rows], "o_totalprice": [p for _, p in rows]}), f"{folder}/orders.parquet", row_group_size=100)
    pq.write_table(pa.table({"c_custkey": list(range(201)), "c_name": ["x"] * 201, "c_nationkey": pa.array([1] * 201, pa.int32()), "c_acctbal": [1.5] * 201}), f"{folder}/customer.parquet")
    pq.write_table(pa.table({"l_orderkey": list(range(n)), "l_linenumber": pa.array([1] * n, pa.int32()), "l_returnflag": ["A"] * n, "l_linestatus": ["F"] * n}), f"{folder}/lineitem.parquet")


def test_floors_of_sums_are_those_of_the_order_of_rows(spark, tmp_path):
    star(tmp_path, random.Random(3))
    con = duckdb.connect()
    con.sql("SET threads = 1")  # with more, DuckDB's own sums depend on which thread is done first
    for t in ("orders", "customer", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert oracle.differences(spark, con, plans.QUERIES["metrics_join"], plans.ORACLES["metrics_join"], str(tmp_path)) == ""
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
