"""Merging logs: first row wins, overlays, resume, routes.

Logs have no order of their own: ``source_no`` and ``line_no`` say which row is
first.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar

ORDER = ("source_no", "line_no")


def _place(order: Iterable[str] = ORDER) -> Column:
    return F.struct(*order)


def _whole(rows: DataFrame, keys: Iterable[str]) -> Column:
    keys = set(keys)
    return F.struct(*(c for c in rows.columns if c not in keys))


def first_per_key(rows: DataFrame, keys: list[str], order: Iterable[str] = ORDER) -> DataFrame:
    """The first row of each key, by a partial aggregate (a key with very many rows is folded before the shuffle)."""
    first = rows.groupBy(*keys).agg(F.min_by(_whole(rows, keys), _place(order)).alias("__row"))
    return first.select(*keys, "__row.*").select(rows.columns)


def last_per_key(rows: DataFrame, keys: list[str], order: Iterable[str] = ORDER) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max_by(_whole(rows, keys), _place(order)).alias("__row"))
    return last.select(*keys, "__row.*").select(rows.columns)


def settle_retries(rows: DataFrame, keys: list[str], failed: str = "clone_failed", order: Iterable[str] = ORDER) -> DataFrame:
    """For each key the first row that didn't fail, else the last row that did."""
    ok = F.col("status") != failed
    best = rows.groupBy(*keys).agg(F.coalesce(F.min_by(F.when(ok, _whole(rows, keys)), F.when(ok, _place(order))), F.max_by(_whole(rows, keys), _place(order))).alias("__row"))
    return best.select(*keys, "__row.*").select(rows.columns)


def overlay(base: DataFrame, again: DataFrame, key: str = "repo_norm", failed: Iterable[str] = dims.FAILED_STATUSES) -> DataFrame:
    """Second-pass rows over first-pass rows, one row a key on each side.

    A second pass replaces a failure if it succeeded, and is noted in
    ``pass2_status`` otherwise; ``pass1_status`` keeps what was replaced.  Keys of
    one side only stay as they are.
    """
    columns = [c for c in base.columns if c != key]
    a = base.select(key, F.struct(*columns).alias("__a"))
    b = again.select(key, F.struct(*(c for c in columns)).alias("__b"))
    both = a.join(b, key, "full_outer")
    replaced = F.col("__a").isNull() | (F.col("__a.status").isin(*failed) & (F.col("__b.status") == "ok"))
    replaced = F.coalesce(replaced, F.lit(False)) & F.col("__b").isNotNull()
    picked = [F.when(replaced, F.col(f"__b.`{c}`")).otherwise(F.col(f"__a.`{c}`")).alias(c) for c in columns]
    had = F.col("__a").isNotNull()
    return both.select(key, *picked, F.when(replaced, "pass2").otherwise("pass1").alias("overlay_source"), F.when(replaced & had, F.col("__a.status")).alias("pass1_status"), F.when(~replaced & F.col("__b").isNotNull(), F.col("__b.status")).alias("pass2_status"))


def without_redundant(again: DataFrame, widened: DataFrame, key: str = "repo_norm") -> DataFrame:
    """Second-pass rows of repositories that the widened rules had not judged yet."""
    return again.join(widened.select(key).distinct(), key, "left_anti")


def not_done(rows: DataFrame, done: Iterable[DataFrame], key: str = "repo_norm") -> DataFrame:
    """Rows whose key no earlier log holds."""
    return reduce(lambda left, log: left.join(log.select(key).distinct(), key, "left_anti"), done, rows)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, and which (``side``)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def settle_routes(log: DataFrame, routes: DataFrame, key: str = "repo_norm") -> DataFrame:
    """Fill an empty ``entry_route``: from settled routes, else inferred for successful scans."""
    settled = routes.filter(scalar.blank_to_null(F.col("entry_route")).isNotNull() & ~F.col("entry_route").isin("unavailable", "unresolved"))
    settled = settled.groupBy(key).agg(F.max("entry_route").alias("__settled"))
    none = F.coalesce(F.col("dockerfiles_found").try_cast("int"), F.lit(0)) == 0
    inferred = F.when(F.col("status") == "ok", F.when(none, "fallback_root").otherwise("dockerfile?"))
    return log.join(settled, key, "left").withColumn("entry_route", F.coalesce(scalar.blank_to_null(F.col("entry_route")), F.col("__settled"), inferred)).drop("__settled")


def ambiguous_routes(log: DataFrame) -> DataFrame:
    """Rows whose route is blank or uncertain although they have Dockerfiles."""
    route = F.coalesce("entry_route", F.lit(""))
    return log.filter(route.isin("", "dockerfile?") & (F.coalesce(F.col("dockerfiles_found").try_cast("int"), F.lit(0)) > 0))


def recoverable(log: DataFrame, markers: Iterable[str] = dims.GONE_MARKERS) -> DataFrame:
    """Failed clones whose detail has no sign that the repository is gone."""
    detail = F.coalesce("detail", F.lit(""))
    gone = reduce(lambda a, m: a | F.contains(detail, F.lit(m)), markers, F.lit(False))
    return log.filter((F.col("status") == "clone_failed") & ~gone)


def failed_once(log: DataFrame, key: str = "repo_norm") -> DataFrame:
    """The first failed row of each key."""
    return first_per_key(log.filter(F.col("status").isin(*dims.FAILED_STATUSES)), [key])


def union_of_headers(logs: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def joined_routes(entries: DataFrame) -> DataFrame:
    """``repo, entry_route``: the distinct routes of a repository, sorted and joined."""
    return entries.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("route")), "+").alias("entry_route"))
