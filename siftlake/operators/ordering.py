"""Row numbers and running sums over a whole table, without one task that sees it all.

Rows are dealt out by ranges of the order, sorted and numbered in each range,
and shifted by what lies in the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import bounded, materialize


def running_sum(df: DataFrame, order: list[str | Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows up to and with this one.  Rows equal in ``order`` follow each other in any order."""
    ranged = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(F.sum(value).alias("__sum"))
    # one row a partition
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy("__at"))
    return ranged.withColumn("__part", part).withColumn("__in", inside).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__in") + F.col("__before")).drop("__part", "__at", "__in", "__before")


def row_numbers(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3 … in the given order, which should have no ties."""
    return running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", out).drop("__one")


def floors_of_sums(df: DataFrame, key: str, value: str, place: list[str], out: str) -> DataFrame:
    """``key, out``: the floor of the sum of the doubles ``value`` under each key, as adding them up one by one by ``place`` gives it.

    Doubles added up in another order may differ in their last bits, and where a sum lies that near to a whole number,
    so does its floor.  Only the keys for which that can be are added up in order; they are few, unless a key has very many rows.
    """
    sums = materialize(df.groupBy(key).agg(F.sum(value).alias("sum"), (F.sum(F.abs(value)) * F.count("*") * F.lit(2.0**-51)).alias("off")))
    clear = F.coalesce(F.floor(F.col("sum") - F.col("off")) == F.floor(F.col("sum") + F.col("off")), F.lit(True))
    unclear = materialize(sums.filter(~clear).select(key))
    upto = F.sum(value).over(Window.partitionBy(key).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    added = df.join(bounded(unclear), key, "left_semi").select(key, *place, upto.alias("upto"))
    last = added.groupBy(key).agg(F.max_by("upto", F.struct(*place)).alias("upto"))
    whole = lambda x: F.floor(x).cast("long").alias(out)
    return sums.filter(clear).select(key, whole(F.col("sum"))).union(last.select(key, whole(F.col("upto"))))


def average_ranks(df: DataFrame, value: str, out: str = "avg_rank") -> DataFrame:
    """``df`` with the rank of ``value``, where ties share the mean of their places; null values have none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    ranks = running_sum(counts, [value], "__n", "__upto").select(value, (F.col("__upto") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, value, "left")
