"""From tool findings to categorized, stage-attributed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar, stages


def attribute_stages(findings: DataFrame, file_stages: DataFrame, reachable: DataFrame) -> DataFrame:
    """Set ``stage`` from the finding's file, by the first rule that fits.

    An empty path is ``unknown``; a file with stage evidence
    (``file_stages(repo_key, path, stage)``) has its sorted stages; a dependency file is
    ``dependencies``; a reachable one (``reachable(repo_key, path)``)
    ``reachable_unmapped``; any other ``unreachable``.
    """
    packed = file_stages.groupBy("repo_key", "path").agg(stages.pack_stages(F.collect_set("stage")).alias("__evidence"))
    known = reachable.select("repo_key", "path").distinct().withColumn("__reached", F.lit(True))
    rel = scalar.strip_dots(scalar.posix(F.coalesce("file_path", F.lit(""))))
    out = findings.withColumn("__path", rel)
    for side in (packed, known):
        out = out.join(side.withColumnRenamed("path", "__path"), ["repo_key", "__path"], "left")
    stage = F.when(F.col("__path") == "", "unknown").when(F.col("__evidence").isNotNull(), F.col("__evidence")).when(scalar.is_dependency_file(F.col("__path")), "dependencies").when(F.col("__reached"), "reachable_unmapped").otherwise("unreachable")
    return out.withColumn("stage", stage).drop("__path", "__evidence", "__reached")


def categorize(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``category`` and ``dropped``: by rule for static findings, by name for absent controls.

    Dependency scanners have one category for all rules; unknown and dropped
    rules have none.  ``rules`` is a dimension of known, small size.
    """
    tool = F.lower(F.coalesce("tool", F.lit("")))
    keyed = findings.withColumns({"__tool": tool, "__rule": F.coalesce("rule_id", F.lit(""))})
    dim = F.broadcast(rules.select(F.col("tool").alias("__tool"), F.col("rule_id").alias("__rule"), F.col("category").alias("__category"), F.col("dropped").alias("__dropped")))
    joined = keyed.join(dim, ["__tool", "__rule"], "left")
    category = F.when(tool.isin(*dims.DEPENDENCY_TOOLS), "vulnerable_dependency").when(tool == dims.CONTROL_TOOL, scalar.control_category(F.col("rule_id"))).otherwise(F.col("__category"))
    return joined.withColumns({"category": category, "dropped": F.coalesce("__dropped", F.lit(False))}).drop("__tool", "__rule", "__category", "__dropped")


def static_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.lower(F.coalesce("tool", F.lit(""))) != dims.CONTROL_TOOL)


def control_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(F.lower(F.coalesce("tool", F.lit(""))) == dims.CONTROL_TOOL)


def of_corpus(findings: DataFrame, corpus: DataFrame) -> DataFrame:
    """Findings of the corpus' repositories, under the corpus' URL."""
    keys = corpus.select(scalar.repo_key(F.col("repo")).alias("repo_key"), F.col("repo").alias("__repo")).distinct()
    return findings.join(keys, "repo_key").withColumn("repo", F.col("__repo")).drop("__repo")


def fact_table(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each finding with twelve columns; unmapped and dropped rules stay, with an empty category."""
    rows = categorize(findings, rules)
    listed = stages.stage_list(F.col("stage"))
    tool = F.lower(F.coalesce("tool", F.lit("")))
    return rows.select(
        "repo",
        tool.alias("tool"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        F.coalesce("category", F.lit("")).alias("semantic_category"),
        scalar.or_default(F.col("severity"), "unknown").alias("severity"),
        F.coalesce(scalar.severity_source(tool), F.lit("")).alias("severity_source"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
        F.coalesce("line", F.lit(0)).alias("line"),
        F.coalesce("stage", F.lit("")).alias("stage_raw"),
        F.array_join(listed, ";").alias("stages"),
        F.size(listed).alias("n_stages"),
        stages.scope(F.col("stage")).alias("scope"),
    )


def explode_stages(rows: DataFrame, mode: str = "expand") -> DataFrame:
    """One row for each matrix row that a finding counts in, with ``matrix_stage`` and ``weight``."""
    at = F.explode(stages.stage_weights(F.col("stage"), mode)).alias("__at")
    return rows.select("*", at).select(*rows.columns, F.col("__at.stage").alias("matrix_stage"), F.col("__at.weight").alias("weight"))
