"""Findings from the JSON reports of security tools, and from answers of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar, text

# Schemas of the reports, one report a row in ``report``.
BANDIT = "results array<struct<issue_severity: string, test_id: string, filename: string, line_number: int, issue_text: string, code: string>>"
SEMGREP = "results array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<severity: string, message: string, lines: string>>>"
PIP_AUDIT = "dependencies array<struct<name: string, version: string, vulns: array<struct<id: string, description: string, fix_versions: array<string>>>>>"
MODELSCAN = "issues array<struct<severity: string, description: string, operator: string>>"
GITLEAKS = "array<struct<RuleID: string, File: string, StartLine: int, Description: string, Match: string>>"
_NB = "array<struct<severity: string, rule_id: string, id: string, file: string, path: string, line: int, cell: int, message: string, description: string, snippet: string, code: string>>"
NBDEFENSE = f"findings {_NB}, issues {_NB}, results {_NB}"


def _finding(tool: str, severity: Column, rule: Column, path: Column, line: Column, message: Column, snippet: Column) -> Column:
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return F.struct(F.lit(tool).alias("tool"), severity.alias("severity"), F.coalesce(rule, F.lit("")).alias("rule_id"), path.alias("file_path"), F.coalesce(line, F.lit(0)).alias("line"), clean(message).alias("message"), clean(snippet).alias("snippet"))


def _rows(reports: DataFrame, items: Column, make) -> DataFrame:
    return reports.select("repo", "root", "file", F.explode(items).alias("r")).select("repo", make(F.col("r")).alias("f")).select("repo", "f.*")


def _below(path: Column) -> Column:
    return scalar.to_relative(F.col("root"), path)


def bandit(reports: DataFrame) -> DataFrame:
    """From ``reports(repo, root, file, report)``; findings below medium are left out."""
    rows = _rows(reports, F.from_json("report", BANDIT)["results"], lambda r: _finding("bandit", scalar.normalize_severity(r["issue_severity"]), r["test_id"], _below(r["filename"]), r["line_number"], r["issue_text"], F.substring(F.trim(r["code"]), 1, 400)))
    return rows.filter(F.col("severity").isin("medium", "high"))


def semgrep(reports: DataFrame) -> DataFrame:
    return _rows(reports, F.from_json("report", SEMGREP)["results"], lambda r: _finding("semgrep", scalar.normalize_severity(r["extra"]["severity"]), r["check_id"], _below(r["path"]), r["start"]["line"], r["extra"]["message"], F.substring(F.trim(r["extra"]["lines"]), 1, 400)))


def pip_audit(reports: DataFrame) -> DataFrame:
    """Every known vulnerability of every package, all of medium severity, in the requirements file ``file``."""
    packages = reports.select("repo", "root", "file", F.explode(F.from_json("report", PIP_AUDIT)["dependencies"]).alias("p"))
    found = packages.select("repo", "root", "file", "p.name", "p.version", F.explode("p.vulns").alias("v"))
    name, version = F.coalesce("name", F.lit("?")), F.coalesce("version", F.lit("?"))
    fixes = F.coalesce(scalar.blank_to_null(F.array_join("v.fix_versions", ", ")), F.lit("no fix listed"))
    message = F.concat(name, F.lit(" "), version, F.lit(": "), F.substring(F.trim(F.coalesce("v.description", F.lit(""))), 1, 200), F.lit(" (fix: "), fixes, F.lit(")"))
    made = _finding("pip_audit", F.lit("medium"), F.coalesce("v.id", F.lit("unknown")), F.col("file"), F.lit(0), message, F.concat(name, F.lit("=="), version))
    return found.select("repo", made.alias("f")).select("repo", "f.*")


def modelscan(reports: DataFrame) -> DataFrame:
    return _rows(reports, F.from_json("report", MODELSCAN)["issues"], lambda r: _finding("modelscan", scalar.normalize_severity(r["severity"]), F.substring(F.coalesce(r["description"], F.lit("unsafe_op")), 1, 60), F.col("file"), F.lit(0), F.substring(F.coalesce(r["description"], F.lit("unsafe model op")), 1, 300), F.substring(r["operator"], 1, 100)))


def gitleaks(reports: DataFrame) -> DataFrame:
    """Leaked secrets are always of high severity."""
    return _rows(reports, F.from_json("report", GITLEAKS), lambda r: _finding("gitleaks", F.lit("high"), r["RuleID"], _below(r["File"]), r["StartLine"], F.coalesce(r["Description"], F.lit("leaked secret")), F.substring(r["Match"], 1, 200)))


def nbdefense(reports: DataFrame) -> DataFrame:
    """Reports name their list ``findings``, ``issues`` or ``results``."""
    parsed = F.from_json("report", NBDEFENSE)
    items = F.coalesce(*(F.when(F.size(parsed[n]) > 0, parsed[n]) for n in ("findings", "issues", "results")))
    return _rows(reports, items, lambda r: _finding("nbdefense", scalar.normalize_severity(r["severity"]), F.substring(F.coalesce(r["rule_id"], r["id"], F.lit("nb")), 1, 60), _below(F.coalesce(r["file"], r["path"])), F.coalesce(F.nullif(r["line"], F.lit(0)), r["cell"]), F.substring(F.trim(F.coalesce(r["message"], r["description"])), 1, 300), F.substring(F.coalesce(r["snippet"], r["code"]), 1, 400)))


#: Tools by name.
ADAPTERS = {"bandit": bandit, "semgrep": semgrep, "pip_audit": pip_audit, "modelscan": modelscan, "gitleaks": gitleaks, "nbdefense": nbdefense}


def control_findings(answers: DataFrame) -> DataFrame:
    """Absent controls from ``answers(repo, stage, files, answer)``; answers that aren't the expected JSON give nothing.

    The finding lies in the first file's bare name.
    """
    rows = answers.select("repo", "stage", "files", F.explode(text.parse_checks(F.col("answer"))).alias("c")).filter(~F.coalesce("c.present", F.lit(False)))
    category = scalar.or_default(F.col("c.category"), "unknown")
    severity = F.when(category.isin(*dims.HIGH_IMPACT_CONTROLS), "high").otherwise("medium")
    path = F.coalesce(scalar.base_name(F.get("files", F.lit(0))), F.lit(""))
    message = F.concat(F.lit("No detected "), F.replace(category, F.lit("_"), F.lit(" ")), F.lit(": "), F.substring(F.trim(F.coalesce("c.justification", F.lit(""))), 1, 300))
    return rows.select("repo", F.lit(dims.CONTROL_TOOL).alias("tool"), severity.alias("severity"), F.concat(F.lit("absent_control."), category).alias("rule_id"), path.alias("file_path"), F.lit(0).alias("line"), message.alias("message"), F.lit("").alias("snippet"), "stage")


def audit_questions(context: DataFrame) -> DataFrame:
    """Stages of ``context(repo, stage, files)`` that are worth a question: those with files."""
    return context.filter("size(files) > 0")


def audit_log(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """Counters of an audit for each repository: calls, stages, findings by severity."""
    a = answers.groupBy("repo").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("stage")), ";").alias("stages"))
    b = findings.groupBy("repo").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    return a.join(b, "repo", "left").na.fill(0, ["findings", "high", "medium"])


def repository_extras(metadata: DataFrame, languages: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each repository asked for: size, bytes by language, commits; ``fetch_ok`` is false where metadata is missing."""
    from .statistics import language_bytes

    out = metadata.join(language_bytes(languages), "repo", "left").join(commits.select("repo", scalar.last_page(F.col("link")).alias("commit_count")), "repo", "left")
    return out.select("repo", "commit_count", "size_kb", "python_bytes", "total_code_bytes", F.col("size_kb").isNotNull().alias("fetch_ok"))


def wide_metrics(repos: DataFrame, endpoints: dict[str, DataFrame]) -> DataFrame:
    """One wide row for each repository from several endpoint tables; blank where one has none."""
    out = repos.select("repo").distinct()
    for part in endpoints.values():
        out = out.join(part, "repo", "left")
    return out
