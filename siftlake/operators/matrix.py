"""Stage by category matrices, summaries, audits and funnels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import stages
from .attribution import explode_stages


def cells(findings: DataFrame, mode: str = "expand") -> DataFrame:
    """``stage, category, weight`` summed over categorized findings; those without a category do not count."""
    rows = explode_stages(findings.filter("category is not null").select("stage", "category"), mode)
    return rows.groupBy(F.col("matrix_stage").alias("stage"), "category").agg(F.sum("weight").alias("weight"))


def matrix(weights: DataFrame, rows: Iterable[str], categories: Iterable[str]) -> DataFrame:
    """Pivot of ``cells`` with all rows and categories, zeros filled in, row totals and a last row ``total``."""
    rows, categories = list(rows), list(categories)
    spark = weights.sparkSession
    kept = weights.filter(F.col("stage").isin(*rows) & F.col("category").isin(*categories))
    sums = [F.sum(F.when(F.col("category") == c, F.col("weight")).otherwise(0.0)).alias(c) for c in categories]
    body = kept.groupBy("stage").agg(*sums)
    frame = F.broadcast(spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "stage string, stage_order int"))
    body = frame.join(body, "stage", "left").na.fill(0.0, categories)
    total = body.agg(*(F.sum(c).alias(c) for c in categories)).select(F.lit("total").alias("stage"), F.lit(len(rows)).alias("stage_order"), *categories)
    out = body.select("stage", "stage_order", *categories).unionByName(total)
    return out.withColumn("total", sum((F.col(c) for c in categories), F.lit(0.0)))


def static_matrix(findings: DataFrame, mode: str = "expand") -> DataFrame:
    return matrix(cells(findings, mode), (*dims.PIPELINE_STAGES, *dims.EXTRA_ROWS), dims.STATIC_CATEGORIES)


def control_matrix(findings: DataFrame) -> DataFrame:
    """Absent controls by pipeline stage; other rows do not count."""
    return matrix(cells(findings), dims.PIPELINE_STAGES, dims.CONTROL_CATEGORIES)


def stage_summary(static: DataFrame, controls: DataFrame, n_repos: int | Column, mode: str = "expand") -> DataFrame:
    """For each pipeline stage: weights of both kinds of findings, share of all pipeline weight, and repositories with static findings, also as a share of ``n_repos``.

    Shares are percentages, null where there is nothing to share.
    """
    spark = static.sparkSession
    used = explode_stages(static.filter("category is not null").select("repo_key", "stage", "category"), mode)
    a = used.groupBy(F.col("matrix_stage").alias("stage")).agg(F.sum("weight").alias("total_findings_static"), F.count_distinct("repo_key").alias("repos_with_findings"))
    b = explode_stages(controls.filter("category is not null").select("stage", "category"), mode).groupBy(F.col("matrix_stage").alias("stage")).agg(F.sum("weight").alias("total_findings_llm"))
    frame = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(dims.PIPELINE_STAGES)], "stage string, stage_order int"))
    out = frame.join(a, "stage", "left").join(b, "stage", "left").na.fill(0)
    # six rows by nature
    whole = F.broadcast(out.agg(F.sum("total_findings_static").alias("__all")))
    n = n_repos if isinstance(n_repos, Column) else F.lit(n_repos)
    share = lambda part, all_: F.try_divide(F.lit(100.0) * part, all_)
    return out.crossJoin(whole).select("stage", "stage_order", "total_findings_static", "total_findings_llm", share(F.col("total_findings_static"), F.col("__all")).alias("pct_of_all_findings"), "repos_with_findings", share(F.col("repos_with_findings"), n).alias("pct_of_repos"))


def rule_audit(findings: DataFrame, order: Column) -> DataFrame:
    """``tool, rule_id, assigned_category, count, example_message`` over all categorized static findings.

    Dropped and unmapped rules are named as such; the example is the first message by ``order``, cut to 200 characters.
    """
    label = F.when(F.col("dropped"), "(dropped)").when(F.col("category").isNull(), "(unmapped)").otherwise(F.col("category"))
    rows = findings.withColumns({"__label": label, "__order": order})
    return rows.groupBy("tool", "rule_id").agg(F.min("__label").alias("assigned_category"), F.count("*").alias("count"), F.min_by(F.substring(F.trim("message"), 1, 200), "__order").alias("example_message"))


def unmapped_rules(audit: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent rules without a category."""
    return audit.filter("assigned_category = '(unmapped)'").orderBy(F.desc("count"), "tool", "rule_id").limit(most)


def audit_report(audit: DataFrame) -> DataFrame:
    """One row: findings in all, dropped and unmapped."""
    part = lambda label: F.coalesce(F.sum(F.when(F.col("assigned_category") == label, F.col("count"))), F.lit(0))
    return audit.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), part("(dropped)").alias("dropped"), part("(unmapped)").alias("unmapped"))


def findings_per_repository(findings: DataFrame) -> DataFrame:
    """``repo, findings_total, findings_pipeline`` of static findings."""
    return findings.groupBy("repo").agg(F.count("*").alias("findings_total"), F.count_if(stages.counts_for_pipeline(F.col("stage"))).alias("findings_pipeline"))


def repository_summary(findings: DataFrame, tools: Iterable[str] = ("bandit", "semgrep", "pip_audit", "modelscan", "gitleaks", "nbdefense")) -> DataFrame:
    """Counts by severity, stage (a finding counts in each of its stages) and tool for each repository."""
    label = F.coalesce("stage", F.lit("unknown"))
    packed = F.when(label == "", F.array(F.lit("unknown"))).otherwise(F.split(label, r"\+"))
    count = lambda test, name: F.count_if(test).alias(name)
    times = lambda name: F.sum(F.size(F.filter(packed, lambda s: s == F.lit(name))))
    in_stage = [times(n).alias(f"{n}_count") for n in (*dims.PIPELINE_STAGES, *dims.OFF_PIPELINE)]
    return findings.groupBy("repo").agg(F.count("*").alias("total_findings"), *(count(F.col("severity") == s, s) for s in dims.SEVERITIES), *in_stage, *(count(F.col("tool") == t, f"{t}_count") for t in tools))


def repository_log(findings: DataFrame) -> DataFrame:
    """Counters of a repository's scan log; all that isn't unreachable counts as reachable."""
    out = F.coalesce("stage", F.lit("")) == "unreachable"
    return findings.groupBy("repo").agg(F.count("*").alias("total_findings"), F.count_if(F.col("severity") == "high").alias("high_findings"), F.count_if(F.col("severity") == "medium").alias("medium_findings"), F.count_if(~out).alias("reachable_findings"), F.count_if(out).alias("unreachable_findings"))


def funnel(log: DataFrame) -> DataFrame:
    """``rule_set, status, n, n_verified`` with a total row (status null) for each rule set."""
    return log.groupingSets([["rule_set", "status"], ["rule_set"]], "rule_set", "status").agg(F.count("*").alias("n"), F.count_if(F.coalesce("verified", F.lit(False))).alias("n_verified"))


def route_counts(log: DataFrame) -> DataFrame:
    return log.filter("verified").groupBy("entry_route").agg(F.count("*").alias("n"))


def stage_histogram(log: DataFrame) -> DataFrame:
    return log.filter("status = 'ok'").groupBy("stages_present").agg(F.count("*").alias("n"))
