"""Scalar functions, stage evidence and import resolution over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar, stages
from ..operators import graph, matching
from .registry import query, table

_MODEL_SUFFIX = "(" + "|".join(e.replace(".", "[.]") for e in dims.MODEL_EXTENSIONS) + ")$"


@query(
    f"""
WITH p AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN './../a/Dockerfile' WHEN 1 THEN '/repo/x/torch.Dockerfile' WHEN 2 THEN '.github/m.PT' WHEN 3 THEN 'models/w.h5' WHEN 4 THEN 'dockerfile.md' WHEN 5 THEN 'node_modules/b/Dockerfile.gpu' ELSE '/repo/src/' || replace(p_name, ' ', '_') || '.py' END AS path FROM part),
b AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS base FROM p)
SELECT p_partkey, ltrim(path, './') AS stripped, CASE WHEN starts_with(path, '/repo/') THEN substring(path, 7) ELSE path END AS relative, regexp_extract(path, '([^/]*)$', 1) AS base_name,
       base = 'dockerfile' OR (starts_with(base, 'dockerfile.') AND NOT regexp_matches(base, '[.](md|txt|rst)$')) OR ends_with(base, '.dockerfile') AS is_dockerfile,
       regexp_matches(lower(path), '{_MODEL_SUFFIX}') AS is_model, starts_with(path, 'node_modules/') AS is_vendored FROM b"""
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 7
    path = F.when(n == 0, "./../a/Dockerfile").when(n == 1, "/repo/x/torch.Dockerfile").when(n == 2, ".github/m.PT").when(n == 3, "models/w.h5").when(n == 4, "dockerfile.md").when(n == 5, "node_modules/b/Dockerfile.gpu").otherwise(F.concat(F.lit("/repo/src/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(".py")))
    p = F.col("path")
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", scalar.strip_dots(p).alias("stripped"), scalar.to_relative(F.lit("/repo"), p).alias("relative"), scalar.base_name(p).alias("base_name"), scalar.is_dockerfile(p).alias("is_dockerfile"), scalar.is_model_file(p).alias("is_model"), scalar.in_directory(p, dims.SKIP_DIRS).alias("is_vendored"))


@query(
    """
WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ' ' || c_custkey || ' ' WHEN 1 THEN '-' || c_custkey ELSE c_name END AS raw, CAST(c_nationkey AS BIGINT) - 3 AS v, c_custkey % 4 AS w, 'o' || c_nationkey || '__n__' || c_custkey AS key FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS digits, CASE WHEN v >= 10 THEN CAST(v AS DOUBLE) END AS commits, CASE WHEN v > 0 THEN CAST(v AS DOUBLE) END AS stars,
       CASE w WHEN 0 THEN '0' WHEN 2 THEN '1' WHEN 1 THEN '0.50' ELSE '1.50' END AS weight, 'https://github.com/' || regexp_replace(key, '__', '/') AS url, 'https://github.com/a/' || c_custkey AS expanded,
       'a__' || c_custkey AS prefix_key, 'u|' || w || '|' AS finding_key FROM c"""
)
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    raw = F.when(n % 3 == 0, F.concat(F.lit(" "), text, F.lit(" "))).when(n % 3 == 1, F.concat(F.lit("-"), text)).otherwise(F.col("c_name"))
    v, w = F.col("c_nationkey").cast("long") - 3, n % 4
    key = F.concat(F.lit("o"), F.col("c_nationkey").cast("string"), F.lit("__n__"), text)
    short = F.concat(F.lit("a/"), text)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalar.digits(raw).alias("digits"), scalar.valid_predictor(v, "commit_count").alias("commits"), scalar.valid_predictor(v, "stars").alias("stars"), scalar.format_weight(w / 2).alias("weight"), scalar.key_to_url(key).alias("url"),
        scalar.expand_repo(short).alias("expanded"), scalar.prefix_key(scalar.expand_repo(short)).alias("prefix_key"), scalar.finding_key(F.lit("u"), w.cast("string"), F.lit(None).cast("string")).alias("finding_key"),
    )


@query(
    """
WITH c AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'pandas.' WHEN 1 THEN 'torch.nn.functional.' WHEN 2 THEN 'numpyx.' ELSE '' END || replace(p_name, ' ', '.') AS name, CAST(p_size AS INT) AS line FROM part)
SELECT name, CAST(line AS BIGINT) AS line, CASE WHEN starts_with(name, 'pandas.') THEN 'pd' || substring(name, 7) WHEN starts_with(name, 'torch.nn.') THEN 'nn' || substring(name, 9) ELSE name END AS short,
       'a.py:' || line || ' ' || name || ' [matched x]' AS evidence FROM c"""
)
def call_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed calls are taken apart, shortened and shown as evidence."""
    n = F.col("p_size") % 4
    head = F.when(n == 0, "pandas.").when(n == 1, "torch.nn.functional.").when(n == 2, "numpyx.").otherwise("")
    packed = table(spark, sf_dir, "part").select(F.concat(head, F.replace(F.col("p_name"), F.lit(" "), F.lit(".")), F.lit("@"), F.col("p_size").cast("string")).alias("entry")).distinct()
    rows = packed.select(scalar.split_call(F.col("entry")).alias("c")).select("c.*")
    return rows.select("name", F.col("line").cast("long").alias("line"), scalar.short_aliases(F.col("name")).alias("short"), scalar.evidence_text(F.lit("a.py"), F.col("line"), F.col("name"), F.lit("x")).alias("evidence"))


_STAGE_OF_LINE = "['" + "', '".join(dims.PIPELINE_STAGES) + "'][(l_linenumber - 1) % 6 + 1]"
_MATCHES = f"WITH m AS (SELECT 's' || l_suppkey AS repo, 'f' || l_partkey || '.py' AS path, l_orderkey AS pos, CAST(floor(l_quantity) AS INT) AS line, {_STAGE_OF_LINE} AS stage FROM lineitem)"


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    stage = F.element_at(F.array(*map(F.lit, dims.PIPELINE_STAGES)), ((F.col("l_linenumber") - 1) % 6 + 1).cast("int"))
    return lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("repo"), F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), F.col("l_orderkey").alias("pos"), F.floor("l_quantity").cast("int").alias("line"), F.lit("call").alias("call"), stage.alias("stage"), F.lit("p").alias("pattern"))


@query(_MATCHES + "SELECT repo, stage, count(DISTINCT path) AS n_files, arg_min(path || ':' || line || ' call [matched p]', pos * 1000000 + CAST(substring(path, 2, length(path) - 4) AS BIGINT)) AS evidence FROM m GROUP BY repo, stage")
def stage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.substring("path", F.lit(2), F.length("path") - 4).cast("long")
    return matching.stage_evidence(_matches(spark, sf_dir).withColumn("part", part), ["pos", "part"]).select("repo", "stage", "n_files", "evidence")


@query(
    _MATCHES
    + f"""
SELECT 's' || s_suppkey AS repo, CAST(count(DISTINCT stage) AS BIGINT) AS stages_present, count(DISTINCT stage) = {len(dims.PIPELINE_STAGES)} AS verified, coalesce(string_agg(DISTINCT stage, '+' ORDER BY stage), '') AS present
FROM supplier LEFT JOIN m ON m.repo = 's' || s_suppkey GROUP BY s_suppkey"""
)
def stage_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = matching.stage_evidence(_matches(spark, sf_dir), ["pos", "path"])
    repos = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("repo"))
    out = matching.presence(evidence, repos)
    return out.select("repo", F.col("stages_present").cast("long").alias("stages_present"), "verified", F.coalesce(stages.pack_stages(F.col("present")), F.lit("")).alias("present"))


@query(
    """
WITH f AS (SELECT 'r' || source AS repo, CASE doc_id % 4 WHEN 0 THEN 'pkg/m' || doc_id || '.py' WHEN 1 THEN 'm' || doc_id || '/__init__.py' ELSE 'lib/m' || doc_id || '.py' END AS path FROM documents),
i AS (SELECT 'r' || source AS repo, doc_id, 'lib/main.py' AS src, CASE doc_id % 4 WHEN 0 THEN 'pkg.m' || doc_id WHEN 1 THEN 'top.m' || doc_id ELSE 'm' || doc_id END AS module, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 0 END AS level FROM documents),
c AS (SELECT repo, module, level, CASE WHEN level = 1 THEN ['lib/' || module || '.py', 'lib/' || module || '/__init__.py']
        WHEN contains(module, '.') THEN [replace(module, '.', '/') || '.py', replace(module, '.', '/') || '/__init__.py', split_part(module, '.', 2) || '.py', split_part(module, '.', 2) || '/__init__.py'] ELSE [module || '.py', module || '/__init__.py'] END AS paths FROM i),
u AS (SELECT repo, module, level, unnest(paths) AS path FROM c)
SELECT c.repo, c.module, CAST(c.level AS BIGINT) AS level, count(f.path) AS n_targets, CASE WHEN count(f.path) > 0 THEN 'inside' WHEN c.level > 0 THEN 'unresolved' ELSE 'external' END AS kind
FROM c LEFT JOIN u USING (repo, module, level) LEFT JOIN f ON f.repo = u.repo AND f.path = u.path GROUP BY c.repo, c.module, c.level"""
)
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    m, repo = F.concat(F.lit("m"), F.col("doc_id").cast("string")), F.concat(F.lit("r"), F.col("source")).alias("repo")
    path = F.when(n == 0, F.concat(F.lit("pkg/"), m, F.lit(".py"))).when(n == 1, F.concat(m, F.lit("/__init__.py"))).otherwise(F.concat(F.lit("lib/"), m, F.lit(".py")))
    module = F.when(n == 0, F.concat(F.lit("pkg."), m)).when(n == 1, F.concat(F.lit("top."), m)).otherwise(m)
    imports = docs.select(repo, F.lit("lib/main.py").alias("src"), module.alias("module"), F.when(n == 2, 1).otherwise(0).alias("level"))
    found = graph.import_candidates(imports).join(docs.select(repo, path.alias("path")), ["repo", "path"]).groupBy("repo", "module", "level").agg(F.count("*").alias("n_targets"))
    _, left = graph.resolve_imports(imports, docs.select(repo, path.alias("path")))
    out = imports.join(found, ["repo", "module", "level"], "left").join(left.select("repo", "module", "level", "kind"), ["repo", "module", "level"], "left")
    return out.select("repo", "module", F.col("level").cast("long").alias("level"), F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("kind", F.lit("inside")).alias("kind"))
