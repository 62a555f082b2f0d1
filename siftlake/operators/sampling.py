"""Samples, top lists, shards and budgeted concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import row_numbers


def stratified_sample(rows: DataFrame, strata: list[str], n: int, order: Column) -> DataFrame:
    """At most ``max(1, n // number of strata)`` rows of each stratum: the least by ``order``, which should be a hash of a key.

    The order replaces a seeded generator, whose sequence cannot be reproduced
    in a distributed run.
    """
    keyed = rows.withColumn("__order", order)
    n_strata = keyed.select(*strata).distinct().count()
    if not n_strata:
        return rows
    quota = max(1, n // n_strata)
    # a first cut by parts of each stratum bounds what one task has to sort
    part = F.pmod(F.xxhash64("__order"), F.lit(64))
    few = keyed.withColumn("__n", F.row_number().over(Window.partitionBy(*strata, part).orderBy("__order"))).filter(F.col("__n") <= quota)
    last = few.withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy("__order"))).filter(F.col("__n") <= quota)
    return last.drop("__n", "__order")


def top(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of an order without ties."""
    return rows.orderBy(*order).limit(n)


def top_by_closed_issues(metrics: DataFrame, n: int) -> DataFrame:
    """Repositories with most closed issues, ties by name downwards; bad or missing counts are 0, which never qualifies."""
    closed = F.coalesce(F.col("closed_issues").try_cast("long"), F.lit(0))
    return top(metrics.select("repo", closed.alias("closed_issues")).filter("closed_issues > 0"), n, [F.desc("closed_issues"), F.desc("repo")])


def round_robin(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``shard``: rows dealt out in turn, 0 to ``n`` - 1, by an order without ties."""
    return row_numbers(rows, order, "__n").withColumn("shard", F.pmod(F.col("__n") - 1, F.lit(n)).cast("int")).drop("__n")


def budget_concat(items: DataFrame, keys: list[str], order: list[str], header: Column, content: Column, *, per_item: int = 4000, budget: int = 12000, least: int = 200) -> DataFrame:
    """``keys…, text``: the items of each key joined in order up to a budget of characters.

    An item's content is cut to ``per_item`` characters, with a note.  The first
    item that would exceed the budget is cut to what is left, if that is more
    than ``least`` characters, and ends the text.  Items after it are not looked at.
    """
    size = F.length(content)
    note = F.concat(F.lit("\n# ... (file truncated, original "), size.cast("string"), F.lit(" chars) ...\n"))
    chunk = F.concat(header, F.when(size <= per_item, content).otherwise(F.concat(F.substring(content, 1, per_item), note)))
    rows = items.select(*keys, *order, chunk.alias("__chunk"))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__upto", F.sum(F.length("__chunk")).over(running)).withColumn("__before", F.col("__upto") - F.length("__chunk"))
    over, left = F.col("__upto") > budget, F.lit(budget) - F.col("__before")
    # the first overflow is the one whose predecessors all fit
    tail = F.when(left > least, F.concat(F.substring(F.col("__chunk"), F.lit(1), left.cast("int")), F.lit("\n# ... (slice truncated) ...\n")))
    used = rows.filter(F.col("__before") <= budget).withColumn("__used", F.when(~over, F.col("__chunk")).otherwise(tail))
    parts = F.array_sort(F.collect_list(F.when(F.col("__used").isNotNull(), F.struct(*order, "__used"))))
    return used.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["__used"]), "").alias("text"))


def first_candidate(candidates: DataFrame, existing: DataFrame, keys: list[str], path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """For each key the candidate with the least ordinal that exists."""
    shared = [*(k for k in keys if k in existing.columns), path]
    found = candidates.join(existing.select(*shared).distinct(), shared)
    return found.groupBy(*keys).agg(F.min_by(F.struct(path, ordinal), ordinal).alias("__best")).select(*keys, "__best.*")


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(order).alias(order))


def limit_in_order(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


