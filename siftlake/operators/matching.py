"""Matching calls to stage signals, and text lines to rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar, text
from ..storage import shuffled


def _tails(name: Column) -> Column:
    """``a.b.c``, ``b.c``, ``c``."""
    parts = F.split(name, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _heads(name: Column) -> Column:
    """Proper prefixes: ``a``, ``a.b`` of ``a.b.c``."""
    parts = F.split(name, "[.]")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def match_signals(calls: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """The first pattern by list order that each distinct call matches in each stage.

    ``calls`` has the ``keys`` and ``call``.  Exact and attribute patterns are
    compared with the call's dotted tails, prefix patterns with its proper dotted
    prefixes, so the match is an equi-join; ``signals`` is a dimension of known size.
    """
    dim = F.broadcast(signals.withColumn("side", F.when(F.col("kind") == "prefix", "head").otherwise("tail")))
    forms = F.concat(F.transform(_tails(F.col("call")), lambda x: F.struct(F.lit("tail").alias("side"), x.alias("lookup"))), F.transform(_heads(F.col("call")), lambda x: F.struct(F.lit("head").alias("side"), x.alias("lookup"))))
    rows = calls.select(*keys, "call", F.explode(forms).alias("form")).select(*keys, "call", "form.side", "form.lookup")
    return rows.join(dim, ["side", "lookup"]).groupBy(*keys, "call", "stage").agg(F.min_by("pattern", "ordinal").alias("pattern"))


def stage_evidence(matches: DataFrame, place: list[str], repo: str = "repo") -> DataFrame:
    """For each repository and stage the first match by ``place``, as text and parts, and the number of files with a match.

    ``matches`` has ``repo, path, line, call, stage, pattern`` and the ``place`` columns.
    """
    first = F.min_by(F.struct("path", "line", "call", "pattern"), F.struct(*place))
    out = matches.groupBy(repo, "stage").agg(first.alias("e"), F.count_distinct("path").alias("n_files"))
    return out.select(repo, "stage", "n_files", "e.*", scalar.evidence_text(F.col("e.path"), F.col("e.line"), F.col("e.call"), F.col("e.pattern")).alias("evidence"))


def file_stages(matches: DataFrame) -> DataFrame:
    return matches.select("repo", "path", "stage").distinct()


def presence(evidence: DataFrame, repos: DataFrame) -> DataFrame:
    """``repo, present, stages_present, verified`` for every repository; verified means all six stages."""
    from .. import dims

    found = evidence.groupBy("repo").agg(F.array_sort(F.collect_set("stage")).alias("present"))
    out = repos.select("repo").distinct().join(shuffled(found), "repo", "left")
    present = F.coalesce("present", F.array().cast("array<string>"))
    return out.select("repo", present.alias("present"), F.size(present).alias("stages_present"), (F.size(F.array_intersect(present, F.array(*map(F.lit, dims.PIPELINE_STAGES)))) == len(dims.PIPELINE_STAGES)).alias("verified"))


def scan_lines(texts: DataFrame, rules: list[tuple[str, str, str, str]], key: str, text_column: str = "text") -> DataFrame:
    """Findings of line-level rules ``(tool, rule_id, severity, pattern)``: one row for each line and rule that it matches.

    ``line`` counts from 1.  Patterns should use only what all regular
    expression dialects share.
    """
    lines = texts.select(key, F.posexplode(F.split(text_column, "\n", -1)).alias("pos", "content"))
    hits = F.array_compact(F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(t).alias("tool"), F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for t, r, s, p in rules)))
    return lines.select(key, (F.col("pos") + 1).alias("line"), "content", F.explode(hits).alias("hit")).select(key, "line", "hit.*", F.substring(F.trim("content"), 1, 400).alias("message"))


def triage(texts: DataFrame, title: Column, body: Column) -> DataFrame:
    """Add ``matched_keywords``, ``pipeline_relevance`` and ``body_excerpt``."""
    found = text.keywords(F.concat_ws("\n", title, F.coalesce(body, F.lit(""))))
    return texts.withColumn("matched_keywords", found).withColumns({"pipeline_relevance": F.size("matched_keywords") > 0, "body_excerpt": text.excerpt(body)})


def issues(feed: DataFrame) -> DataFrame:
    """Closed issues of a raw feed, without pull requests, triaged."""
    rows = triage(feed.filter("pull_request is null"), F.col("title"), F.col("body"))
    return rows.select("repo", F.col("number").alias("issue_number"), "title", text.join_labels(F.col("labels")).alias("labels"), "created_at", "closed_at", F.coalesce("comments", F.lit(0)).alias("comments"), "pipeline_relevance", F.array_join("matched_keywords", ";").alias("matched_keywords"), "body_excerpt")
