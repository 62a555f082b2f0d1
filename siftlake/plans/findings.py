"""Findings over the text corpus: line rules, facts, matrices, audits, agreement, triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar, stages
from ..operators import attribution, matching, matrix, sampling, statistics
from .registry import query, table

#: Line rules (tool, rule, severity as the tool words it, pattern); their categories follow from the rule dimension.
LINE_RULES = [
    ("semgrep", "python.jwt.security.jwt-hardcode.jwt-python-hardcoded-secret", "ERROR", "(api[_-]?key|secret|password|token)[ ]*[=:]"),
    ("bandit", "B104", "MEDIUM", "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"),
    ("bandit", "B113", "LOW", "[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]{2,}"),
    ("bandit", "B507", "warning", "[+][0-9]+ ?[(][0-9]+[)]"),
    ("semgrep", "generic.license.license-line", "note", "([Ll]icen[cs]e|[Cc]opyright)"),
    ("pip_audit", "GPL", "moderate", "General Public"),
]

_VALUES = ", ".join("('" + "', '".join(r) + "')" for r in LINE_RULES)
_RULES = ", ".join(f"('{t}', '{r}', '{c}', false)" for t, r, c in dims.rule_rows()) + ", " + ", ".join(f"('{t}', '{r}', NULL, true)" for t, rs in dims.DROPPED_RULES.items() for r in rs)
_STAGES = ", ".join(f"('{s}', {i})" for i, s in enumerate((*dims.PIPELINE_STAGES, *dims.EXTRA_ROWS)))
_SEVERITY = "CASE " + " ".join(f"WHEN lower(trim(sev)) IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in dims.SEVERITY_WORDS.items()) + " WHEN coalesce(trim(sev), '') = '' THEN 'unknown' ELSE lower(trim(sev)) END"
_STAGE = "CASE lang WHEN 'en' THEN CASE WHEN doc_id % 3 = 0 THEN 'evaluation+training' ELSE 'data_acquisition' END WHEN 'de' THEN CASE WHEN doc_id % 2 = 0 THEN 'data_preparation+inference+modeling' ELSE 'unreachable' END WHEN 'fr' THEN 'dependencies' ELSE 'training' END"

CTE = f"""
WITH rules(tool, rule_id, sev, pattern) AS (VALUES {_VALUES}),
rule_dim(tool, rule_id, category, dropped) AS (VALUES {_RULES}),
stage_dim(stage, stage_order) AS (VALUES {_STAGES}),
lines AS (
  SELECT doc_id, lang, source, l[i] AS content, i AS line
  FROM (SELECT doc_id, lang, source, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents))),
findings AS (
  SELECT doc_id, lang, source AS repo, CAST(line AS BIGINT) AS line, tool, rule_id, {_SEVERITY} AS severity, substring(trim(content), 1, 400) AS message, {_STAGE} AS stage
  FROM lines JOIN rules ON regexp_matches(content, pattern)),
categorized AS (
  SELECT f.*, CASE WHEN f.tool IN ('pip_audit', 'pip-audit') THEN 'vulnerable_dependency' ELSE d.category END AS category, coalesce(d.dropped, false) AS dropped
  FROM findings f LEFT JOIN rule_dim d ON f.tool = d.tool AND f.rule_id = d.rule_id),
listed AS (SELECT *, list_filter(string_split(stage, '+'), lambda x: list_contains([{", ".join(repr(s) for s in dims.PIPELINE_STAGES)}], x)) AS known FROM categorized),
used AS (SELECT *, CASE WHEN len(known) > 0 THEN known WHEN stage = 'dependencies' THEN ['dependencies'] ELSE ['out_of_scope'] END AS rows_in FROM listed)"""


def _stage_label() -> Column:
    doc = F.col("doc_id")
    return (
        F.when(F.col("lang") == "en", F.when(doc % 3 == 0, stages.pack_stages(F.array(F.lit("training"), F.lit("evaluation")))).otherwise("data_acquisition"))
        .when(F.col("lang") == "de", F.when(doc % 2 == 0, stages.pack_stages(F.array(F.lit("modeling"), F.lit("inference"), F.lit("data_preparation")))).otherwise("unreachable"))
        .when(F.col("lang") == "fr", "dependencies")
        .otherwise("training")
    )


def line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, repo, line, tool, rule_id, severity, message, stage`` of all line rules over all documents."""
    docs = table(spark, sf_dir, "documents").withColumn("__key", F.struct("doc_id", "lang", "source"))
    hits = matching.scan_lines(docs, LINE_RULES, "__key").select("__key.*", "line", "tool", "rule_id", "severity", "message")
    return hits.select("doc_id", "lang", F.col("source").alias("repo"), F.col("line").cast("long").alias("line"), "tool", "rule_id", scalar.normalize_severity(F.col("severity")).alias("severity"), "message", _stage_label().alias("stage"))


def _categorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.categorize(line_findings(spark, sf_dir), dims.rule_dim(spark))


@query(CTE + "SELECT doc_id, line, tool, rule_id, severity, message FROM findings")
def finding_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_findings(spark, sf_dir).select("doc_id", "line", "tool", "rule_id", "severity", "message")


@query(
    CTE
    + """
SELECT repo, doc_id, tool, rule_id, coalesce(category, '') AS semantic_category, severity,
       CASE tool WHEN 'bandit' THEN 'bandit_rule' WHEN 'semgrep' THEN 'semgrep_rule' ELSE 'pip_audit' END AS severity_source, line, stage AS stage_raw,
       array_to_string(known, ';') AS stages, CAST(len(known) AS BIGINT) AS n_stages,
       CASE WHEN len(known) > 0 THEN 'pipeline' WHEN stage = 'dependencies' THEN 'dependencies' ELSE 'out_of_scope' END AS scope
FROM listed"""
)
def finding_fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_findings(spark, sf_dir).withColumn("file_path", F.col("doc_id").cast("string"))
    return attribution.fact_table(rows, dims.rule_dim(spark)).select("repo", F.col("file_path").cast("long").alias("doc_id"), "tool", "rule_id", "semantic_category", "severity", "severity_source", "line", "stage_raw", "stages", F.col("n_stages").cast("long").alias("n_stages"), "scope")


def _matrix_sql(expression: str, weight: str) -> str:
    sums = ", ".join(f"sum(CASE WHEN category = '{c}' THEN w ELSE 0e0 END) AS {c}" for c in dims.STATIC_CATEGORIES)
    zeros = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in dims.STATIC_CATEGORIES)
    total = " + ".join(dims.STATIC_CATEGORIES)
    again = ", ".join(f"sum({c}) AS {c}" for c in dims.STATIC_CATEGORIES)
    return (
        CTE
        + f""",
weighted AS (SELECT unnest({expression}) AS stage, category, {weight} AS w FROM used WHERE category IS NOT NULL),
body AS (SELECT stage, {sums} FROM weighted GROUP BY stage),
filled AS (SELECT d.stage, {zeros} FROM stage_dim d LEFT JOIN body USING (stage)),
whole AS (SELECT * FROM filled UNION ALL SELECT 'total', {again} FROM filled)
SELECT stage, {", ".join(f"round({c}, 6) AS {c}" for c in dims.STATIC_CATEGORIES)}, round({total}, 6) AS total FROM whole"""
    )


def _matrix(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    out = matrix.static_matrix(_categorized(spark, sf_dir), mode)
    return out.select("stage", *(F.round(c, 6).alias(c) for c in (*dims.STATIC_CATEGORIES, "total")))


@query(_matrix_sql("rows_in", "1e0"))
def stage_category_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "expand")


@query(_matrix_sql("rows_in[1:1]", "1e0"))
def stage_matrix_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "primary")


@query(_matrix_sql("rows_in", "1e0 / len(rows_in)"))
def stage_matrix_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, "fractional")


@query(
    CTE
    + """,
weighted AS (SELECT unnest(rows_in) AS stage, repo FROM used WHERE category IS NOT NULL),
body AS (SELECT stage, CAST(count(*) AS DOUBLE) AS n, count(DISTINCT repo) AS repos FROM weighted GROUP BY stage),
six AS (SELECT d.stage, coalesce(n, 0) AS n, coalesce(repos, 0) AS repos FROM stage_dim d LEFT JOIN body USING (stage) WHERE stage_order < 6)
SELECT stage, n AS total_findings_static, round(100e0 * n / nullif((SELECT sum(n) FROM six), 0), 6) AS pct_of_all_findings, CAST(repos AS BIGINT) AS repos_with_findings,
       round(100e0 * repos / (SELECT count(DISTINCT source) FROM documents), 6) AS pct_of_repos
FROM six"""
)
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _categorized(spark, sf_dir).withColumn("repo_key", F.col("repo"))
    n_repos = table(spark, sf_dir, "documents").agg(F.count_distinct("source")).first()[0]
    out = matrix.stage_summary(attribution.static_findings(rows), attribution.control_findings(rows), n_repos)
    return out.select("stage", "total_findings_static", F.round("pct_of_all_findings", 6).alias("pct_of_all_findings"), F.col("repos_with_findings").cast("long").alias("repos_with_findings"), F.round("pct_of_repos", 6).alias("pct_of_repos"))


_AUDIT = """,
audit AS (
  SELECT tool, rule_id, min(CASE WHEN dropped THEN '(dropped)' WHEN category IS NULL THEN '(unmapped)' ELSE category END) AS assigned_category, count(*) AS count,
         arg_min(substring(trim(message), 1, 200), doc_id * 1000000 + line) AS example_message
  FROM categorized GROUP BY tool, rule_id)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.rule_audit(_categorized(spark, sf_dir), F.struct("doc_id", "line"))


@query(CTE + _AUDIT + "SELECT tool, rule_id, assigned_category, count, example_message FROM audit")
def rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)


@query(CTE + _AUDIT + "SELECT tool, rule_id, count FROM audit WHERE assigned_category = '(unmapped)' ORDER BY count DESC, tool, rule_id LIMIT 10")
def unmapped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.unmapped_rules(_audit(spark, sf_dir)).select("tool", "rule_id", "count")


@query(CTE + _AUDIT + "SELECT CAST(coalesce(sum(count), 0) AS BIGINT) AS total, CAST(coalesce(sum(count) FILTER (assigned_category = '(dropped)'), 0) AS BIGINT) AS dropped, CAST(coalesce(sum(count) FILTER (assigned_category = '(unmapped)'), 0) AS BIGINT) AS unmapped FROM audit")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.audit_report(_audit(spark, sf_dir))


@query(
    CTE
    + f"""
SELECT repo, count(*) AS total_findings, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES)},
       {", ".join(f"count(*) FILTER (list_contains(string_split(stage, '+'), '{s}')) AS {s}_count" for s in (*dims.PIPELINE_STAGES, *dims.OFF_PIPELINE))},
       {", ".join(f"count(*) FILTER (tool = '{t}') AS {t}_count" for t in ("bandit", "semgrep", "pip_audit", "modelscan", "gitleaks", "nbdefense"))}
FROM findings GROUP BY repo"""
)
def repository_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.repository_summary(line_findings(spark, sf_dir))


@query(CTE + "SELECT repo, count(*) AS total_findings, count(*) FILTER (severity = 'high') AS high_findings, count(*) FILTER (severity = 'medium') AS medium_findings, count(*) FILTER (stage <> 'unreachable') AS reachable_findings, count(*) FILTER (stage = 'unreachable') AS unreachable_findings FROM findings GROUP BY repo")
def repository_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.repository_log(line_findings(spark, sf_dir))


@query(
    CTE
    + """,
counted AS (SELECT repo, count(*) AS t, count(*) FILTER (len(known) > 0) AS p FROM listed GROUP BY repo),
sizes AS (SELECT source AS repo, sum(n_chars) AS n FROM documents GROUP BY source)
SELECT repo, CAST(coalesce(t, 0) AS BIGINT) AS findings_total, CAST(coalesce(p, 0) AS BIGINT) AS findings_pipeline,
       round(1000e0 * coalesce(t, 0) / nullif(n, 0), 9) AS density_total, round(1000e0 * coalesce(p, 0) / nullif(n, 0), 9) AS density_pipeline
FROM sizes LEFT JOIN counted USING (repo)"""
)
def density_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = matrix.findings_per_repository(attribution.static_findings(line_findings(spark, sf_dir)))
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo")).agg(F.sum("n_chars").alias("n"))
    out = sizes.join(counts, "repo", "left").na.fill(0, ["findings_total", "findings_pipeline"])
    return out.select("repo", "findings_total", "findings_pipeline", *(F.round(scalar.density(F.col(f"findings_{k}"), F.col("n")), 9).alias(f"density_{k}") for k in ("total", "pipeline")))


@query(
    """
WITH evidence AS (SELECT DISTINCT doc_id, CASE WHEN quality = 1 THEN 'training' ELSE 'evaluation' END AS stage FROM labels
                  UNION SELECT doc_id, 'inference' FROM labels WHERE toxic = 1),
packed AS (SELECT doc_id, string_agg(DISTINCT stage, '+' ORDER BY stage) AS stage FROM evidence GROUP BY doc_id),
paths AS (SELECT doc_id, source, lang, CASE doc_id % 7 WHEN 0 THEN './src/f' || doc_id || '.py' WHEN 1 THEN 'requirements/r' || doc_id || '.txt' WHEN 2 THEN 'base-requirements.txt' WHEN 3 THEN '' WHEN 4 THEN '.github/f' || doc_id || '.py' ELSE 'src/f' || doc_id || '.py' END AS path FROM documents),
rel AS (SELECT doc_id, source, lang, ltrim(path, './') AS rel FROM paths)
SELECT doc_id, rel AS path,
  CASE WHEN rel = '' THEN 'unknown'
       WHEN p.stage IS NOT NULL AND rel = 'src/f' || doc_id || '.py' THEN p.stage
       WHEN (list_contains(string_split(rel, '/'), 'requirements') AND rel LIKE '%.txt') OR rel LIKE '%-requirements.txt' THEN 'dependencies'
       WHEN lang IN ('en', 'de') AND rel = 'src/f' || doc_id || '.py' THEN 'reachable_unmapped'
       ELSE 'unreachable' END AS stage
FROM rel LEFT JOIN packed p USING (doc_id)"""
)
def stage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    n, name = F.col("doc_id"), F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py"))
    path = F.when(n % 7 == 0, F.concat(F.lit("./"), name)).when(n % 7 == 1, F.concat(F.lit("requirements/r"), n.cast("string"), F.lit(".txt"))).when(n % 7 == 2, "base-requirements.txt").when(n % 7 == 3, "").when(n % 7 == 4, F.concat(F.lit(".github/f"), n.cast("string"), F.lit(".py"))).otherwise(name)
    findings = docs.select("doc_id", F.col("source").alias("repo_key"), path.alias("file_path"))
    every = labels.join(docs.select("doc_id", F.col("source").alias("repo_key")), "doc_id")
    a = every.select("repo_key", name.alias("path"), F.when(F.col("quality") == 1, "training").otherwise("evaluation").alias("stage"))
    b = every.filter("toxic = 1").select("repo_key", name.alias("path"), F.lit("inference").alias("stage"))
    reachable = docs.filter("lang in ('en', 'de')").select(F.col("source").alias("repo_key"), name.alias("path"))
    out = attribution.attribute_stages(findings, a.union(b), reachable)
    return out.select("doc_id", scalar.strip_dots(F.col("file_path")).alias("path"), "stage")


_KAPPA = """
WITH j AS (SELECT {group} AS scope, quality = 1 AS a, toxic = 1 AS b FROM labels JOIN documents USING (doc_id)),
s AS (SELECT scope, count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(CAST(a AS INT)) AS pa, avg(CAST(b AS INT)) AS pb FROM j GROUP BY scope),
e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM s)
SELECT {column}n, round(100 * po, 9) AS agreement_pct, round(CASE WHEN pe = 1 THEN CASE WHEN po = 1 THEN 1e0 ELSE 0e0 END ELSE (po - pe) / (1 - pe) END, 9) AS cohens_kappa FROM e"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    both = statistics.agreement(rows.select("lang", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")), "a", "b", "lang")
    return both.select("scope", "n", F.round("agreement_pct", 9).alias("agreement_pct"), F.round("cohens_kappa", 9).alias("cohens_kappa"))


@query(_KAPPA.format(group="1", column=""))
def kappa_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("scope is null").drop("scope")


@query(_KAPPA.format(group="lang", column="scope, "))
def kappa_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("scope is not null")


@query(
    """
WITH s AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents)),
r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR))) AS k FROM documents)
SELECT doc_id, lang, source FROM r, s WHERE k <= greatest(1, 150 // n)"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.stratified_sample(docs, ["lang", "source"], 150, F.md5(F.col("doc_id").cast("string").cast("binary")))


@query(
    """
WITH c AS (
  SELECT conv_id, turn, chr(10) || '# === file: ' || role || ' ===' || chr(10) || CASE WHEN length(text) <= 300 THEN text ELSE substring(text, 1, 300) || chr(10) || '# ... (file truncated, original ' || length(text) || ' chars) ...' || chr(10) END AS chunk FROM conversations),
u AS (SELECT *, sum(length(chunk)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM c),
k AS (SELECT *, upto - length(chunk) AS before FROM u),
t AS (SELECT conv_id, turn, CASE WHEN upto <= 900 THEN chunk WHEN 900 - before > 50 THEN substring(chunk, 1, CAST(900 - before AS BIGINT)) || chr(10) || '# ... (slice truncated) ...' || chr(10) END AS piece FROM k WHERE before <= 900)
SELECT conv_id, coalesce(string_agg(piece, '' ORDER BY turn), '') AS text FROM t GROUP BY conv_id"""
)
def budget_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("\n# === file: "), F.col("role"), F.lit(" ===\n"))
    return sampling.budget_concat(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], header, F.col("text"), per_item=300, budget=900, least=50)


_KEYWORDS = "|".join(dims.ISSUE_KEYWORDS).replace("-", "[-]")


@query(
    f"""
WITH d AS (SELECT doc_id, 'doc ' || lang AS title, text AS body FROM documents UNION ALL SELECT -1 - page_id, url, html FROM pages)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(title || chr(10) || body, '(?i){_KEYWORDS}'), lambda x: lower(x)))), ';') AS matched_keywords,
       len(regexp_extract_all(title || chr(10) || body, '(?i){_KEYWORDS}')) > 0 AS pipeline_relevance, substring(translate(body, chr(13) || chr(10), '  '), 1, 400) AS body_excerpt
FROM d"""
)
def keyword_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), "lang").alias("title"), F.col("text").alias("body"))
    pages = table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("title"), F.col("html").alias("body"))
    out = matching.triage(docs.union(pages), F.col("title"), F.col("body"))
    return out.select("doc_id", F.array_join("matched_keywords", ";").alias("matched_keywords"), "pipeline_relevance", "body_excerpt")


#: A few signals over part names, of every kind.
PART_SIGNALS = [("modeling", "ring"), ("modeling", ".widget"), ("modeling", "ECONOMY.*"), ("training", "small.bolt"), ("training", "STANDARD.*"), ("training", ".gear"), ("inference", "gizmo"), ("inference", "SMALL.red.*")]


@query(
    f"""
WITH signals(stage, ordinal, pattern) AS (VALUES {", ".join(f"('{s}', {i}, '{p}')" for i, (s, p) in enumerate(PART_SIGNALS))}),
calls AS (SELECT DISTINCT p_type || '.' || replace(p_name, ' ', '.') AS call FROM part)
SELECT call, stage, arg_min(pattern, ordinal) AS pattern FROM calls JOIN signals ON CASE
  WHEN ends_with(pattern, '.*') THEN starts_with(call, substring(pattern, 1, length(pattern) - 1))
  WHEN starts_with(pattern, '.') THEN ends_with(call, pattern) OR call = substring(pattern, 2)
  ELSE call = pattern OR ends_with(call, '.' || pattern) END
GROUP BY call, stage"""
)
def signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "part").select(F.concat_ws(".", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("call")).distinct()
    return matching.match_signals(calls, dims.signal_dim(spark, PART_SIGNALS), [])


@query(
    """
SELECT p.page_id, r.rule_id, CAST(len(regexp_extract_all(p.html, r.pattern)) AS BIGINT) AS n
FROM pages p, (VALUES ('script', '<script'), ('href', 'href="[^"]*"'), ('comment', '<!--')) r(rule_id, pattern) WHERE regexp_matches(p.html, r.pattern)"""
)
def html_template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("script", "<script"), ("href", 'href="[^"]*"'), ("comment", "<!--"))
    counts = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.regexp_count("html", F.lit(p)).cast("long").alias("n")) for r, p in rules))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(counts).alias("c")).select("page_id", "c.*").filter("n > 0")


@query(
    """
WITH a AS (SELECT conv_id, turn, role FROM conversations),
c AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'data_poisoning_defenses' ELSE 'input_validation' END AS category FROM a WHERE (conv_id + turn) % 3 <> 0)
SELECT CAST(conv_id AS VARCHAR) AS repo, category, 'absent_control.' || category AS rule_id, CASE WHEN category = 'data_poisoning_defenses' THEN 'high' ELSE 'medium' END AS severity,
       'No detected ' || replace(category, '_', ' ') || ': turn ' || turn AS message FROM c"""
)
def control_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an audit, written as fenced JSON from conversations and read back."""
    from ..operators import tools

    rows = table(spark, sf_dir, "conversations")
    check = F.struct(F.when(F.col("turn") % 2 == 0, "data_poisoning_defenses").otherwise("input_validation").alias("category"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).alias("present"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("justification"))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(check).alias("checks"))), F.lit("\n```"))
    answers = rows.select(F.col("conv_id").cast("string").alias("repo"), F.lit("training").alias("stage"), F.array(F.lit("src/a.py")).alias("files"), answer.alias("answer"))
    return tools.control_findings(answers).select("repo", scalar.control_category(F.col("rule_id")).alias("category"), "rule_id", "severity", "message")
