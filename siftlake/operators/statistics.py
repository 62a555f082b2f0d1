"""Rank correlations, agreement, densities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar
from ..storage import materialize
from .ordering import running_sum


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null below three rows or for a constant column."""
    n, varies = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()), (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    xx, yy, xy = F.var_pop(x), F.var_pop(y), F.covar_pop(x, y)
    return F.when((n >= 3) & varies, F.try_divide(xy, F.sqrt(xx * yy)))


def unpivot_pairs(rows: DataFrame, key: str, predictors: Iterable[str], outcomes: Iterable[str]) -> DataFrame:
    """``predictor, outcome, x, y`` for every pair of columns of every row in which both are valid."""
    xs = F.array(*(F.struct(F.lit(p).alias("predictor"), scalar.valid_predictor(F.col(p), p).alias("x")) for p in predictors))
    ys = F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes))
    wide = rows.select(key, F.explode(xs).alias("p"), ys.alias("ys"))
    return wide.filter("p.x is not null").select(key, "p.*", F.explode("ys").alias("o")).filter("o.y is not null").select(key, "predictor", "x", "o.outcome", "o.y")


def spearman(pairs: DataFrame, groups: list[str], least: int = dims.MIN_PAIR_ROWS) -> DataFrame:
    """``n_repos, rho`` of each group of ``pairs(groups…, x, y)`` with at least ``least`` rows.

    Ranks within a group follow from counts of its distinct values, so that a
    group of any size is shared among tasks.
    """
    pairs = materialize(pairs)

    def ranked(value: str, out: str) -> DataFrame:
        counts = pairs.groupBy(*groups, value).agg(F.count("*").alias("__n"))
        upto = running_sum(counts, [*groups, value], "__n", "__upto")
        sizes = pairs.groupBy(*groups).agg(F.count("*").alias("__all"))
        # sums run over all groups in order: what lies before a group is taken off
        before = running_sum(sizes, groups, "__all", "__end").select(*groups, (F.col("__end") - F.col("__all")).alias("__before"))
        return upto.join(F.broadcast(before), groups).select(*groups, value, (F.col("__upto") - F.col("__before") - (F.col("__n") - 1) / F.lit(2.0)).alias(out))

    both = pairs.join(ranked("x", "rx"), [*groups, "x"]).join(ranked("y", "ry"), [*groups, "y"])
    return both.groupBy(*groups).agg(F.count("*").alias("n_repos"), pearson("rx", "ry").alias("rho")).filter(F.col("n_repos") >= least)


def correlation_rows(metrics: DataFrame, extras: DataFrame, loc: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each repository of ``metrics``: all measures, findings (0 if none) and densities (null without lines)."""
    out = metrics.join(extras, "repo", "left").join(loc, "repo", "left").join(counts, "repo", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("findings_total", "findings_pipeline")})
    return out.withColumns({f"density_{k}": scalar.density(F.col(f"findings_{k}"), F.col("loc_reachable")) for k in ("total", "pipeline")})


def correlation_table(rows: DataFrame, key: str = "repo", predictors: Iterable[str] = dims.PREDICTORS, outcomes: Iterable[str] = dims.OUTCOMES) -> DataFrame:
    return spearman(unpivot_pairs(rows, key, predictors, outcomes), ["predictor", "outcome"])


def log_axis(value: str) -> Column:
    """Whether an axis should be logarithmic: positive values that span more than two orders of magnitude."""
    return (F.min(value) > 0) & (F.try_divide(F.max(value).cast("double"), F.min(value).cast("double")) > 100)


def kappa(a: Column, b: Column) -> list[Column]:
    """Aggregates ``n, agreement_pct, cohens_kappa`` of two boolean columns; rows with a null do not count.

    Without rows both are null; if chance agreement is 1, kappa is 1 for full
    agreement and 0 otherwise.
    """
    ok = a.isNotNull() & b.isNotNull()
    n = F.count_if(ok)
    share = lambda test: F.try_divide(F.count_if(ok & test).cast("double"), n.cast("double"))
    po, pa, pb = share(a == b), share(a), share(b)
    pe = pa * pb + (1 - pa) * (1 - pb)
    return [n.alias("n"), (100 * po).alias("agreement_pct"), F.when(pe == 1.0, F.when(po == 1.0, 1.0).otherwise(0.0)).otherwise(F.try_divide(po - pe, 1 - pe)).alias("cohens_kappa")]


def agreement(judged: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Agreement overall (``scope`` null) and for each group."""
    return judged.groupingSets([[], [group]], group).agg(*kappa(F.col(a), F.col(b))).withColumnRenamed(group, "scope")


def reachable_loc(listed: DataFrame, files: DataFrame) -> DataFrame:
    """``repo_key, n_reachable_files, n_files_found, loc_reachable``: lines of the listed files that exist."""
    lines = files.select(F.col("repo").alias("repo_key"), "path", scalar.line_count(F.col("content")).alias("lines"))
    joined = listed.select("repo_key", "path").join(lines, ["repo_key", "path"], "left")
    return joined.groupBy("repo_key").agg(F.count("*").alias("n_reachable_files"), F.count("lines").alias("n_files_found"), F.coalesce(F.sum("lines"), F.lit(0)).alias("loc_reachable"))


def language_bytes(rows: DataFrame, languages: str = "languages") -> DataFrame:
    """Add ``python_bytes`` and ``total_code_bytes`` from a map of bytes by language."""
    total = F.aggregate(F.map_values(languages), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumns({"python_bytes": F.coalesce(F.try_element_at(languages, F.lit("Python")), F.lit(0)).cast("long"), "total_code_bytes": F.coalesce(total, F.lit(0))})
