"""Sinks: CSV with fixed fields, resumable append logs, files per repository, reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar


def with_fields(rows: DataFrame, fields: Iterable[str]) -> DataFrame:
    """The fields in order as text; missing ones and nulls are empty."""
    return rows.select(*((F.coalesce(F.col(f).cast("string"), F.lit("")) if f in rows.columns else F.lit("")).alias(f) for f in fields))


def write_csv(rows: DataFrame, path: str, fields: Iterable[str]) -> None:
    with_fields(rows, fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a Parquet log.  Keys already there should be removed first (see ``merging.not_done``)."""
    rows.write.mode("append").parquet(path)


def write_per_repository(findings: DataFrame, path: str) -> None:
    """One JSON folder for each repository key; a repeated write replaces the repositories it holds and leaves the others."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_key").json(path)


def snapshot_json() -> Column:
    """A snapshot row as JSON text."""
    return F.to_json(F.struct("repo", "entry_route", "entry_files", "stages_present", "analysis", "reachable_files", F.col("context_files").alias("rq2_context_files")))


def relabel_snapshots(snapshots: DataFrame, corpus: DataFrame, routes: DataFrame) -> DataFrame:
    """Snapshots with route, entry files and stage count from the corpus, else from the settled routes."""
    meta = corpus.select(scalar.prefix_key(F.col("repo")).alias("repo_key"), F.col("repo").alias("corpus_repo"), F.col("entry_route").alias("corpus_route"), F.col("entry_files").alias("corpus_files"), F.col("stages_present").try_cast("int").alias("corpus_stages"))
    settled = routes.select(scalar.prefix_key(F.col("repo")).alias("repo_key"), F.col("entry_route").alias("settled_route"))
    out = snapshots.join(meta, "repo_key", "left").join(settled, "repo_key", "left")
    route = F.coalesce(scalar.blank_to_null(F.col("corpus_route")), scalar.blank_to_null(F.col("settled_route")), F.col("entry_route"))
    files = F.coalesce(F.filter(F.split("corpus_files", ";"), lambda x: x != ""), F.col("entry_files"))
    return out.withColumns({"repo": F.coalesce("corpus_repo", "repo"), "entry_route": route, "entry_files": files, "stages_present": F.coalesce("corpus_stages", "stages_present")}).drop("corpus_repo", "corpus_route", "corpus_files", "corpus_stages", "settled_route")


def shards(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """``shard``: rows dealt out in turn by their order."""
    from ..operators.sampling import round_robin

    return round_robin(rows, n, order)


def funnel_markdown(funnel: DataFrame) -> str:
    """Markdown table of a funnel (``rule_set, status, n``), which has a few rows by nature."""
    rows = funnel.orderBy("rule_set", F.desc("n"), "status").select("rule_set", "status", F.format_number("n", 0)).collect()
    return "\n".join(["| rules | status | repositories |", "|---|---|---:|", *(f"| {a} | {b} | {c} |" for a, b, c in rows)]) + "\n"


def matrix_fields(categories: Iterable[str] = dims.STATIC_CATEGORIES) -> list[str]:
    return ["stage", *categories, "total"]
