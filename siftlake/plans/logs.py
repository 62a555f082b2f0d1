"""Logs and metrics over the star schema: merging, resume, funnels, ranks, correlations, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import scalar
from ..operators import graph, matrix, merging, ordering, sampling, statistics
from .registry import query, table

# ---------------------------------------------------------------- severities


@query(
    """
SELECT o_orderkey, CASE regexp_replace(lower(o_orderpriority), '^[0-9]-', '') WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE regexp_replace(lower(o_orderpriority), '^[0-9]-', '') END AS severity FROM orders"""
)
def severity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", scalar.normalize_severity(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("severity"))


@query(
    """
SELECT CAST(o_custkey AS VARCHAR) AS repo, count(*) AS total_findings, count(*) FILTER (o_orderpriority = '2-HIGH') AS high_findings, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium_findings,
       count(*) FILTER (o_orderstatus <> 'F') AS reachable_findings, count(*) FILTER (o_orderstatus = 'F') AS unreachable_findings FROM orders GROUP BY o_custkey"""
)
def severity_summary_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").cast("string").alias("repo"), scalar.normalize_severity(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("severity"), F.when(F.col("o_orderstatus") == "F", "unreachable").otherwise("training").alias("stage"))
    return matrix.repository_log(rows)


# ---------------------------------------------------------------- scan logs on events

_LOG = """
WITH log AS (
  SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'clone_failed' WHEN 'signup' THEN 'no_entry' ELSE 'ok' END AS status,
         CASE WHEN event_id % 3 = 0 THEN 'widened' ELSE 'original' END AS rule_set, event_id % 5 = 0 AND event_type NOT IN ('error', 'signup') AS verified,
         CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 1 ELSE 2 END AS pass
  FROM events)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "error", "clone_failed").when(kind == "signup", "no_entry").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("user_id").alias("repo_norm"),
        status.alias("status"),
        F.when(F.col("event_id") % 3 == 0, "widened").otherwise("original").alias("rule_set"),
        ((F.col("event_id") % 5 == 0) & (status == "ok")).alias("verified"),
        F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"), 1).otherwise(2).alias("pass"),
        F.lit(0).alias("source_no"),
        F.col("event_id").alias("line_no"),
    )


@query(_LOG + "SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(status, event_id) AS status FROM log GROUP BY user_id")
def scan_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.first_per_key(_log(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "status")


_RETRIES = """,
settled AS (SELECT user_id, coalesce(min(event_id) FILTER (status <> 'clone_failed'), max(event_id)) AS event_id FROM log {where} GROUP BY user_id)"""


@query(_LOG + _RETRIES.format(where="") + "SELECT user_id, event_id, status FROM settled JOIN log USING (user_id, event_id)")
def scan_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.settle_retries(_log(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "status")


@query(
    _LOG
    + """,
a AS (SELECT user_id, min(event_id) AS event_id FROM log WHERE pass = 1 GROUP BY user_id),
one AS (SELECT user_id, event_id, status FROM a JOIN log USING (user_id, event_id))"""
    + _RETRIES.format(where="WHERE pass = 2")
    + """,
two AS (SELECT user_id, event_id, status FROM settled JOIN log USING (user_id, event_id)),
b AS (SELECT coalesce(one.user_id, two.user_id) AS user_id, one.event_id AS e1, one.status AS s1, two.event_id AS e2, two.status AS s2,
             coalesce(one.user_id IS NULL OR (one.status IN ('no_entry', 'no_dockerfile') AND two.status = 'ok'), false) AND two.user_id IS NOT NULL AS replaced
      FROM one FULL JOIN two ON one.user_id = two.user_id)
SELECT user_id, CASE WHEN replaced THEN e2 ELSE e1 END AS event_id, CASE WHEN replaced THEN s2 ELSE s1 END AS status, CASE WHEN replaced THEN 'pass2' ELSE 'pass1' END AS overlay_source,
       CASE WHEN replaced AND s1 IS NOT NULL THEN s1 END AS pass1_status, CASE WHEN NOT replaced THEN s2 END AS pass2_status FROM b"""
)
def scan_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    base = merging.first_per_key(log.filter("pass = 1"), ["repo_norm"])
    again = merging.settle_retries(log.filter("pass = 2"), ["repo_norm"])
    out = merging.overlay(base, again)
    return out.select(F.col("repo_norm").alias("user_id"), "event_id", "status", "overlay_source", "pass1_status", "pass2_status")


@query(_LOG + "SELECT rule_set, status, count(*) AS n, count(*) FILTER (verified) AS n_verified FROM log GROUP BY GROUPING SETS ((rule_set, status), (rule_set))")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.funnel(_log(spark, sf_dir))


@query(_LOG + "SELECT event_id, user_id FROM log WHERE status = 'clone_failed' AND user_id % 4 <> 0")
def recoverable_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("detail", F.when(F.col("user_id") % 4 == 0, "fatal: repository not found").otherwise("timeout"))
    return merging.recoverable(log).select("event_id", "user_id")


@query(
    """
WITH o AS (SELECT o_custkey AS user_id, o_orderkey AS line, o_orderstatus AS status, NULL AS verified FROM orders),
e AS (SELECT user_id, event_id AS line, event_type AS status, event_id % 5 = 0 AS verified FROM events),
u AS (SELECT *, 0 AS source_no FROM o UNION ALL SELECT *, 1 AS source_no FROM e)
SELECT user_id, arg_min(line, source_no * 1000000000 + line) AS line, arg_min(status, source_no * 1000000000 + line) AS status, arg_min(coalesce(CAST(verified AS VARCHAR), ''), source_no * 1000000000 + line) AS verified FROM u GROUP BY user_id"""
)
def log_union_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("status"), F.lit(0).alias("source_no"))
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), F.col("event_type").alias("status"), (F.col("event_id") % 5 == 0).alias("verified"), F.lit(1).alias("source_no"))
    out = merging.first_per_key(merging.union_of_headers([orders, events]), ["user_id"])
    return out.select("user_id", F.col("line_no").alias("line"), "status", F.coalesce(F.col("verified").cast("string"), F.lit("")).alias("verified"))


# ---------------------------------------------------------------- routes, resume, coverage


@query(
    """
WITH r AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'dockerfile' WHEN 2 THEN 'fallback_nested' ELSE '' END AS route FROM nation)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'console' END, nullif(CASE WHEN route = 'unavailable' THEN '' ELSE route END, ''),
  CASE WHEN c_mktsegment <> 'BUILDING' THEN CASE WHEN c_custkey % 3 = 0 THEN 'fallback_root' ELSE 'dockerfile?' END END) AS entry_route
FROM customer LEFT JOIN r ON c_nationkey = n_nationkey"""
)
def route_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey") % 4
    routes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("repo_norm"), F.when(n == 0, "unavailable").when(n == 1, "dockerfile").when(n == 2, "fallback_nested").otherwise("").alias("entry_route"))
    log = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("repo_norm"), F.when(F.col("c_custkey") % 5 == 0, "console").otherwise("").alias("entry_route"), F.when(F.col("c_mktsegment") == "BUILDING", "error").otherwise("ok").alias("status"), (F.col("c_custkey") % 3).cast("string").alias("dockerfiles_found"))
    return merging.settle_routes(log, routes).select("c_custkey", "entry_route")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return merging.not_done(table(spark, sf_dir, "customer").select("c_custkey"), [orders.filter("o_orderstatus = 'P'"), orders.filter("o_totalprice > 400000")], "c_custkey")


@query(
    """
WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT k AS c_custkey, 'left' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'right' FROM b WHERE k NOT IN (SELECT k FROM a)"""
)
def coverage_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    right = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return merging.coverage(left, right, "c_custkey")


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_name) - 1) % 6 AS INT) AS shard FROM customer")
def shard_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), 6, ["c_name"]).select("c_custkey", "shard")


@query("SELECT CAST(o_custkey AS VARCHAR) AS repo, count(*) AS closed_issues FROM orders GROUP BY o_custkey ORDER BY closed_issues DESC, repo DESC LIMIT 20")
def topk_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("repo")).agg(F.count("*").alias("closed_issues"))
    return sampling.top_by_closed_issues(counts, 20)


# ---------------------------------------------------------------- metrics, ranks, correlations

_METRICS = """
WITH o AS (SELECT o_custkey AS repo, count(*) AS commit_count, CAST(floor(sum(o_totalprice)) AS BIGINT) AS size_kb FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey AS repo, sum(l_linenumber) AS loc_reachable, count(*) FILTER (l_returnflag = 'A') AS t, count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
m AS (SELECT c_custkey AS repo, CAST(floor(c_acctbal) AS BIGINT) AS stars, c_nationkey AS forks, length(c_name) AS contributors FROM customer),
r AS (SELECT m.repo, stars, forks, contributors, commit_count, size_kb, CAST(loc_reachable AS BIGINT) AS loc_reachable, coalesce(t, 0) AS findings_total, coalesce(p, 0) AS findings_pipeline,
             1000e0 * coalesce(t, 0) / nullif(loc_reachable, 0) AS density_total, 1000e0 * coalesce(p, 0) / nullif(loc_reachable, 0) AS density_pipeline
      FROM m LEFT JOIN o USING (repo) LEFT JOIN l USING (repo))"""


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    metrics = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo"), F.floor("c_acctbal").cast("long").alias("stars"), F.col("c_nationkey").alias("forks"), F.length("c_name").alias("contributors"))
    # sums of prices in the order of the table: in another one their floors may differ
    prices = orders.select(F.col("o_custkey").alias("repo"), "o_totalprice", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = ordering.floors_of_sums(prices, "repo", "o_totalprice", ["file", "row"], "size_kb")
    extras = orders.groupBy(F.col("o_custkey").alias("repo")).agg(F.count("*").alias("commit_count")).join(sizes, "repo", "left")
    measured = lines.groupBy(F.col("o_custkey").alias("repo")).agg(F.sum("l_linenumber").alias("loc_reachable"), F.count_if(F.col("l_returnflag") == "A").alias("findings_total"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("findings_pipeline"))
    return statistics.correlation_rows(metrics, extras, measured.select("repo", "loc_reachable"), measured.select("repo", "findings_total", "findings_pipeline"))


@query(_METRICS + "SELECT repo, stars, CAST(forks AS BIGINT) AS forks, CAST(contributors AS BIGINT) AS contributors, commit_count, size_kb, loc_reachable, findings_total, findings_pipeline, round(density_total, 6) AS density_total, round(density_pipeline, 6) AS density_pipeline FROM r")
def metrics_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _metric_rows(spark, sf_dir)
    longs = ("stars", "forks", "contributors", "commit_count", "size_kb", "loc_reachable", "findings_total", "findings_pipeline")
    return rows.select("repo", *(F.col(c).cast("long").alias(c) for c in longs), *(F.round(c, 6).alias(c) for c in ("density_total", "density_pipeline")))


@query(
    """
SELECT c_custkey AS key, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2e0 AS avg_rank FROM customer
UNION ALL SELECT -1 - p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0 FROM part"""
)
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ordering.average_ranks(table(spark, sf_dir, "customer"), "c_acctbal").select(F.col("c_custkey").alias("key"), "avg_rank")
    b = ordering.average_ranks(table(spark, sf_dir, "part"), "p_size").select((-1 - F.col("p_partkey")).alias("key"), "avg_rank")
    return a.union(b)


_PREDICTORS = ("loc_reachable", "commit_count", "size_kb", "contributors", "stars", "forks")


@query(
    _METRICS
    + f""",
x AS (UNPIVOT (SELECT repo, {", ".join(f"CASE WHEN {p} > 0 AND {p} >= {dims.MIN_COMMIT_COUNT if p == 'commit_count' else 0} THEN CAST({p} AS DOUBLE) END AS {p}" for p in _PREDICTORS)} FROM r) ON {", ".join(_PREDICTORS)} INTO NAME predictor VALUE x),
y AS (UNPIVOT (SELECT repo, {", ".join(f"CAST({o} AS DOUBLE) AS {o}" for o in dims.OUTCOMES)} FROM r) ON {", ".join(dims.OUTCOMES)} INTO NAME outcome VALUE y),
p AS (SELECT repo, predictor, outcome, x, y FROM x JOIN y USING (repo)),
k AS (SELECT predictor, outcome, rank() OVER (PARTITION BY predictor, outcome ORDER BY x) + (count(*) OVER (PARTITION BY predictor, outcome, x) - 1) / 2e0 AS rx,
             rank() OVER (PARTITION BY predictor, outcome ORDER BY y) + (count(*) OVER (PARTITION BY predictor, outcome, y) - 1) / 2e0 AS ry FROM p)
SELECT predictor, outcome, count(*) AS n_repos, CASE WHEN count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 9) END AS rho FROM k GROUP BY predictor, outcome HAVING count(*) >= {dims.MIN_PAIR_ROWS}"""
)
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.correlation_table(_metric_rows(spark, sf_dir), predictors=_PREDICTORS)
    return out.select("predictor", "outcome", "n_repos", F.round("rho", 9).alias("rho"))


@query("SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000e0) AS BIGINT) AS age_days FROM events GROUP BY user_id")
def age_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("string").alias("created_at"), F.max("ts").cast("string").alias("pushed_at"))
    return rows.select("user_id", scalar.elapsed_days(scalar.parse_time(F.col("created_at")), scalar.parse_time(F.col("pushed_at"))).alias("age_days"))


# ---------------------------------------------------------------- keys, paths, texts


@query(
    """
WITH p AS (SELECT page_id, 'https://github.com/' || n_name || '/repo' || page_id || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '.git' ELSE '' END AS url, n_name FROM pages JOIN nation ON page_id % 25 = n_nationkey)
SELECT page_id, n_name || '__repo' || page_id || CASE page_id % 3 WHEN 1 THEN '.git' ELSE '' END AS repo_key, lower(rtrim(url, '/')) AS url_key, n_name AS owner, 'repo' || page_id AS name, n_name || '__repo' || page_id || CASE page_id % 3 WHEN 1 THEN '.git' ELSE '' END || '.json' AS file_name FROM p"""
)
def repo_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name"))  # 25 rows
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", (n % 25).alias("k")).join(nations, "k")
    url = F.concat(F.lit("https://github.com/"), "n_name", F.lit("/repo"), n.cast("string"), F.when(n % 3 == 0, "/").when(n % 3 == 1, ".git").otherwise(""))
    rows = pages.select("page_id", url.alias("url"))
    parts = scalar.parse_repo_url(F.col("url"))
    return rows.select("page_id", scalar.repo_key(F.col("url")).alias("repo_key"), scalar.url_key(F.col("url")).alias("url_key"), parts["owner"].alias("owner"), parts["name"].alias("name"), scalar.file_name(F.col("url")).alias("file_name"))


_DEPENDENCY = ", ".join(repr(x) for x in dims.DEPENDENCY_FILES)


@query(
    f"""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'requirements/' || page_id || '.txt' WHEN 1 THEN 'a/Pipfile' WHEN 2 THEN regexp_extract(url, '://[^/]*/(.*)$', 1) WHEN 3 THEN 'x-requirements.txt' WHEN 4 THEN 'src/requirements-' || page_id ELSE 'docs/requirements.md' END AS path FROM pages),
b AS (SELECT *, lower(regexp_extract(path, '([^/]*)$', 1)) AS base FROM p)
SELECT page_id, path, base IN ({_DEPENDENCY}) OR (list_contains(string_split(path, '/'), 'requirements') AND ends_with(base, '.txt')) OR ends_with(base, '-requirements.txt') OR starts_with(base, 'requirements-') AS is_dependency FROM b"""
)
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    path = F.when(n % 6 == 0, F.concat(F.lit("requirements/"), n.cast("string"), F.lit(".txt"))).when(n % 6 == 1, "a/Pipfile").when(n % 6 == 2, F.regexp_extract("url", "://[^/]*/(.*)$", 1)).when(n % 6 == 3, "x-requirements.txt").when(n % 6 == 4, F.concat(F.lit("src/requirements-"), n.cast("string"))).otherwise("docs/requirements.md")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("is_dependency", scalar.is_dependency_file(F.col("path")))


@query(
    """
WITH c AS (SELECT s_nationkey AS k, s_suppkey AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS ordinal FROM supplier),
e AS (SELECT DISTINCT l_suppkey AS path FROM lineitem WHERE l_quantity > 40)
SELECT k AS n_nationkey, arg_min(path, ordinal) AS s_suppkey, min(ordinal) AS ordinal FROM c JOIN e USING (path) GROUP BY k"""
)
def fallback_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    candidates = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("path"), F.row_number().over(order).cast("long").alias("ordinal"))
    existing = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_suppkey").alias("path"))
    return sampling.first_candidate(candidates, existing, ["n_nationkey"]).select("n_nationkey", F.col("path").alias("s_suppkey"), "ordinal")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.line_count(F.col("text")).alias("lines"))


@query("SELECT event_type, CAST(sum(CAST(props ->> 'k' AS BIGINT)) AS BIGINT) AS k_sum, count(*) AS n, CAST(count(DISTINCT props ->> 'k') AS BIGINT) AS k_distinct FROM events GROUP BY event_type")
def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"), F.count_distinct("k").alias("k_distinct"))


@query("SELECT source AS repo, list_sort(list('d' || doc_id)) AS reachable_files, count(*) AS n FROM documents GROUP BY source")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots written as JSON text and read again."""
    from .. import schemas
    from ..sources.writers import snapshot_json

    docs = table(spark, sf_dir, "documents")
    made = docs.groupBy(F.col("source").alias("repo")).agg(F.array_sort(F.collect_list(F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias("reachable_files"))
    made = made.withColumns({"entry_route": F.lit("dockerfile"), "entry_files": F.array(F.lit("main.py")), "stages_present": F.lit(6), "analysis": F.lit("call_graph"), "context_files": F.create_map(F.lit("training"), F.col("reachable_files"))})
    back = made.select(F.from_json(snapshot_json(), schemas.SNAPSHOT).alias("s")).select("s.*")
    return back.select("repo", F.try_element_at("rq2_context_files", F.lit("training")).alias("reachable_files"), F.size("reachable_files").cast("long").alias("n"))


# ---------------------------------------------------------------- graphs


@query(
    """
WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_quantity > 49),
w(node, depth) AS (SELECT 'p' || p_partkey, 0 FROM part WHERE p_size = 1 UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 25)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY node"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    edges = lines.select(F.lit("r").alias("repo"), part.alias("src"), supplier.alias("dst")).union(lines.filter("l_quantity > 49").select(F.lit("r"), supplier, part))
    seeds = table(spark, sf_dir, "part").filter("p_size = 1").select(F.lit("r").alias("repo"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    return graph.reachability(seeds, edges).select("node", F.col("depth").cast("long").alias("depth"))


@query(
    """
WITH f AS (SELECT source AS repo, doc_id, CAST(len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents WHERE lang <> 'fr')
SELECT d.source AS repo_key, count(*) AS n_reachable_files, count(lines) AS n_files_found, CAST(coalesce(sum(lines), 0) AS BIGINT) AS loc_reachable FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.source"""
)
def reachable_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    return statistics.reachable_loc(docs.select(F.col("source").alias("repo_key"), path), docs.filter("lang <> 'fr'").select(F.col("source").alias("repo"), path, F.col("text").alias("content")))
