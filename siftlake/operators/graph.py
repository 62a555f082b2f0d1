"""Reachability over import graphs, and what hangs on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..storage import bounded, materialize, shuffled


def reachability(seeds: DataFrame, edges: DataFrame, max_depth: int = 25, closed: DataFrame | None = None) -> DataFrame:
    """``repo, node, depth``: the least number of edges from any seed, up to ``max_depth``.

    ``seeds(repo, node)``, ``edges(repo, src, dst)``; nodes in ``closed(repo, node)`` (files
    that cannot be parsed) are reached but not left.  One frontier is expanded at a time, so a
    node is visited once however many paths lead to it.
    """
    frontier = materialize(seeds.select("repo", "node").distinct().withColumn("depth", F.lit(0)))
    edges = materialize(edges.select("repo", "src", "dst").distinct())
    closed = closed.select("repo", "node").distinct() if closed is not None else None
    seen = frontier
    for depth in range(1, max_depth + 1):
        leaving = frontier.join(shuffled(closed), ["repo", "node"], "left_anti") if closed is not None else frontier
        step = bounded(leaving.select("repo", F.col("node").alias("src")))
        reached = edges.join(step, ["repo", "src"]).select("repo", F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(shuffled(seen), ["repo", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = materialize(seen.unionByName(frontier))
    return seen


def reachability_sql(seeds: str, edges: str, max_depth: int) -> str:
    """The same for shallow graphs as one recursive query over two views; it walks all paths."""
    return f"""
    WITH RECURSIVE walk(repo, node, depth) AS (
      SELECT DISTINCT repo, node, 0 FROM {seeds}
      UNION ALL
      SELECT e.repo, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.repo = w.repo AND e.src = w.node WHERE w.depth < {max_depth})
    SELECT repo, node, min(depth) AS depth FROM walk GROUP BY repo, node"""


def import_candidates(imports: DataFrame) -> DataFrame:
    """``…, path, ordinal``: where an import ``(repo, src, module, level)`` may lead, likeliest first.

    Relative imports start at the importing file's folder, one folder up for
    each level above one.  Absolute ones start at the root, once with and once
    without the first part of the name.
    """
    folder = F.slice(F.split("src", "/"), 1, F.greatest(F.size(F.split("src", "/")) - F.greatest("level", F.lit(1)), F.lit(0)))
    parts = F.filter(F.split(F.coalesce("module", F.lit("")), "[.]"), lambda x: x != "")
    base = F.when(F.col("level") > 0, F.concat(folder, parts)).otherwise(parts)
    inner = F.when((F.col("level") == 0) & (F.size(parts) > 1), F.slice(parts, 2, F.size(parts)))
    file = lambda p: F.concat(F.array_join(p, "/"), F.lit(".py"))
    package = lambda p: F.array_join(F.concat(p, F.array(F.lit("__init__.py"))), "/")
    paths = F.array(file(base), package(base), file(inner), package(inner))
    return imports.select("*", F.posexplode(paths).alias("ordinal", "path")).filter("path is not null and path <> '.py'")


def resolve_imports(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``repo, src, dst`` inside the repository, and the imports that lead to no file (``kind`` is external, or unresolved for relative ones)."""
    existing = files.select("repo", "path").distinct()
    found = import_candidates(imports).join(shuffled(existing), ["repo", "path"])
    edges = found.select("repo", "src", F.col("path").alias("dst")).distinct()
    keys = ["repo", "src", "module", "level"]
    left = imports.select(*keys).distinct().join(shuffled(found.select(*keys).distinct()), keys, "left_anti")
    return edges, left.withColumn("kind", F.when(F.col("level") > 0, "unresolved").otherwise("external"))


def module_candidates(modules: DataFrame) -> DataFrame:
    """``…, path, ordinal``: files that ``python -m module`` may run, likeliest first."""
    parts = F.split("module", "[.]")
    inner = F.when(F.size(parts) > 1, F.slice(parts, 2, F.size(parts)))
    file = lambda p: F.concat(F.array_join(p, "/"), F.lit(".py"))
    main = lambda p: F.array_join(F.concat(p, F.array(F.lit("__main__.py"))), "/")
    return modules.select("*", F.posexplode(F.array(file(parts), main(parts), file(inner), main(inner))).alias("ordinal", "path")).filter("path is not null")


def graph_summary(nodes: DataFrame, unresolved: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Files, functions of distinct files, depth, errors, dynamic imports and unresolved imports of each repository.

    ``nodes(repo, entry, path, depth, n_functions, parse_error)`` has a row for each
    entry point's graph; functions count once a file, errors once a graph.
    """
    files = nodes.groupBy("repo", "path").agg(F.max("n_functions").alias("n_functions"))
    a = files.groupBy("repo").agg(F.count("*").alias("reachable_files"), F.sum("n_functions").alias("total_functions"))
    b = nodes.groupBy("repo").agg(F.max("depth").alias("max_depth"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_errors"))
    c = dynamic.groupBy("repo").agg(F.count("*").alias("dynamic_imports"))
    d = unresolved.filter("kind = 'unresolved'").groupBy("repo").agg(F.array_sort(F.collect_set(F.concat_ws(": ", "src", "module"))).alias("unresolved_imports"))
    out = a.join(shuffled(b), "repo").join(shuffled(c), "repo", "left").join(shuffled(d), "repo", "left")
    return out.withColumns({"dynamic_imports": F.coalesce("dynamic_imports", F.lit(0)), "unresolved_imports": F.coalesce("unresolved_imports", F.array().cast("array<string>"))})


def audit_context(reachable: DataFrame, presence: DataFrame, files: DataFrame) -> DataFrame:
    """``repo, stage, files`` for all six stages: every reachable file that exists under each present stage, none under the others.

    A repository whose stages could not be verified (no row in ``presence``) counts
    as having all of them.
    """
    existing = reachable.join(shuffled(files.select("repo", F.col("path").alias("node")).distinct()), ["repo", "node"])
    listed = existing.groupBy("repo").agg(F.transform(F.array_sort(F.collect_set(F.struct("depth", "node"))), lambda x: x["node"]).alias("files"))
    stages = F.array(*map(F.lit, dims.PIPELINE_STAGES))
    rows = listed.join(shuffled(presence.select("repo", "present")), "repo", "left").select("repo", "files", F.coalesce("present", stages).alias("present"), F.explode(stages).alias("stage"))
    return rows.select("repo", "stage", F.when(F.array_contains("present", F.col("stage")), F.col("files")).otherwise(F.array().cast("array<string>")).alias("files"))


def scan_rollup(summary: DataFrame, presence: DataFrame, evidence: DataFrame, entries: DataFrame) -> DataFrame:
    """One scan row for each repository: graph counters, stages with their evidence, entry files and status."""
    from .merging import joined_routes
    from ..functions import scalar

    texts = evidence.groupBy("repo").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "evidence")))).alias("stage_evidence"))
    files = entries.filter("entry_file is not null").groupBy("repo").agg(F.array_sort(F.collect_set("entry_file")).alias("entry_files"))
    out = entries.select("repo").distinct()
    for side in (joined_routes(entries), files, summary, presence, texts):
        out = out.join(shuffled(side), "repo", "left")
    status = F.when(F.col("entry_files").isNull(), "no_entry").otherwise("ok")
    return out.withColumns({"status": status, "detail": F.when(status == "ok", scalar.missing_stages_text(F.col("present"))).otherwise(F.lit("no entry point"))})
