"""Column functions and operators on hand-made rows, one for each trap of the semantics."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from siftlake import dims, schemas
from siftlake.functions import scalar, stages, text
from siftlake.operators import attribution, graph, matching, matrix, merging, ordering, parsing, sampling, statistics, tools
from siftlake.sources import readers, writers
from siftlake.streaming import logs


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    "value, expected",
    [("CRITICAL", "high"), ("Error", "high"), ("moderate", "medium"), ("WARNING", "medium"), ("note", "info"), ("low", "low"), (None, "unknown"), ("", "unknown"), ("  ", "unknown"), ("Odd", "odd"), ("Very High", "high"), ("INFO", "info")],
)
def test_severities(spark, value, expected):
    assert values(spark, [value], "s string", scalar.normalize_severity(F.col("s"))) == [expected]


def test_keys(spark):
    urls = ["https://github.com/o/n/", "https://github.com/o/n", "word", "a/b"]
    assert values(spark, urls, "u string", scalar.repo_key(F.col("u"))) == ["o__n", "o__n", "word", "a__b"]
    assert values(spark, ["http:x"], "u string", scalar.file_name(F.col("u"))) == ["http_x.json"]
    assert values(spark, ["o__n__m", "x"], "u string", scalar.key_to_url(F.col("u"))) == ["https://github.com/o/n__m", "x"]
    assert values(spark, [" HTTPS://A/b/ ", None], "u string", scalar.url_key(F.col("u"))) == ["https://a/b", ""]
    assert values(spark, ["o/n", "http://x", None], "u string", scalar.expand_repo(F.col("u"))) == ["https://github.com/o/n", "http://x", ""]
    assert values(spark, ["https://github.com/o/n.git", "git@github.com:o/n", "no"], "u string", scalar.parse_repo_url(F.col("u"))) == [("o", "n"), ("o", "n"), None]
    assert values(spark, ["https://github.com/o/n/x"], "u string", scalar.prefix_key(F.col("u"))) == ["o__n__x"]
    assert values(spark, [("u", None, "r")], "a string, b string, c string", scalar.finding_key(F.col("a"), F.col("b"), F.col("c"))) == ["u||r"]
    assert values(spark, ["https://h/o/n", "x"], "u string", scalar.owner_and_name(F.col("u"))) == [("o", "n"), None]


def test_paths(spark):
    paths = ["requirements.txt", "a/Requirements.TXT", "requirements/dev.txt", "x/requirements/a.txt", "base-requirements.txt", "requirements-dev.in", "setup.py", "a.py", "requirements.md", "Pipfile"]
    assert values(spark, paths, "p string", scalar.is_dependency_file(F.col("p"))) == [True, True, True, True, True, True, True, False, False, True]
    assert values(spark, [".github/x.py", "./a", "..//b"], "p string", scalar.strip_dots(F.col("p"))) == ["github/x.py", "a", "b"]
    assert values(spark, [("/r", "/r/a/b.py"), ("/r", "c"), ("/r", None)], "r string, p string", scalar.to_relative(F.col("r"), F.col("p"))) == ["a/b.py", "c", ""]
    names = ["Dockerfile", "x/dockerfile.GPU", "Dockerfile.md", "torch.Dockerfile", "Dockerfiles"]
    assert values(spark, names, "p string", scalar.is_dockerfile(F.col("p"))) == [True, True, False, True, False]


def test_numbers(spark):
    assert values(spark, ["12", " 7 ", "-3", "1.5", "", None], "s string", scalar.digits(F.col("s"))) == [12, 7, None, None, None, None]
    assert values(spark, [1.0, 2.5, 1 / 3], "x double", scalar.format_weight(F.col("x"))) == ["1", "2.50", "0.33"]
    assert values(spark, [(5, 0), (5, None), (5, 1000)], "n long, loc long", scalar.density(F.col("n"), F.col("loc"))) == [None, None, 5.0]
    assert values(spark, [9, 10, 0], "v long", scalar.valid_predictor(F.col("v"), "commit_count")) == [None, 10.0, None]
    times = [("2024-01-01T00:00:00Z", "2024-01-02T23:59:59Z"), ("bad", "2024-01-01T00:00:00Z")]
    assert values(spark, times, "a string, b string", scalar.elapsed_days(scalar.parse_time(F.col("a")), scalar.parse_time(F.col("b")))) == [1, None]
    assert values(spark, ["", "a", "a\n", "a\nb", None], "s string", scalar.line_count(F.col("s"))) == [0, 1, 1, 2, None]
    assert values(spark, ['<https://x?page=2>; rel="next", <https://x?per=1&page=34>; rel="last"', None], "s string", scalar.last_page(F.col("s"))) == [34, None]
    assert values(spark, ["a.b@12", "x", "a@b@3", "a@b"], "s string", scalar.split_call(F.col("s"))) == [("a.b", 12), ("x", 0), ("a@b", 3), ("a@b", 0)]
    assert values(spark, ["pandas.read_csv", "torch.nn.functional.relu", "pandasx.y", "numpy"], "s string", scalar.short_aliases(F.col("s"))) == ["pd.read_csv", "nn.functional.relu", "pandasx.y", "np"]
    assert values(spark, ["hint: x\nfatal: gone\n", "only\nlast", None], "s string", scalar.failure_reason(F.col("s"))) == ["fatal: gone", "last", ""]
    assert values(spark, [(["training"],), (None,)], "s array<string>", scalar.missing_stages_text(F.col("s")))[0].startswith("missing: data_acquisition, data_preparation")


LABELS = ["", None, "training", "evaluation+training", "dependencies", "unreachable", "bogus", "training+bogus", "training + evaluation"]


def test_stage_labels(spark):
    weights = lambda mode: [[(w.stage, w.weight) for w in ws] for ws in values(spark, LABELS, "s string", stages.stage_weights(F.col("s"), mode))]
    out, one = [("out_of_scope", 1.0)], [("training", 1.0)]
    assert weights("expand") == [out, out, one, [("evaluation", 1.0), ("training", 1.0)], [("dependencies", 1.0)], out, out, one, [("training", 1.0), ("evaluation", 1.0)]]
    assert weights("primary")[3] == [("evaluation", 1.0)]
    assert weights("fractional")[3] == [("evaluation", 0.5), ("training", 0.5)]
    assert values(spark, LABELS, "s string", stages.scope(F.col("s"))) == ["out_of_scope", "out_of_scope", "pipeline", "pipeline", "dependencies", "out_of_scope", "out_of_scope", "pipeline", "pipeline"]
    # the correlation counts do not trim
    assert values(spark, ["a + training", "a+training"], "s string", stages.counts_for_pipeline(F.col("s"))) == [False, True]
    assert values(spark, ["a+b", "a", None], "s string", stages.is_multi_stage(F.col("s"))) == [True, False, False]
    with pytest.raises(ValueError):
        stages.stage_weights(F.col("s"), "other")


def test_texts(spark):
    assert values(spark, ["GPU gpu Pre-Trained pretrained", None], "s string", text.keywords(F.col("s"))) == [["gpu", "pre-trained", "pretrained"], []]
    assert values(spark, ["a\r\nb" + "x" * 500], "s string", text.excerpt(F.col("s")))[0] == "a  b" + "x" * 396
    answer = '```json\n{"checks": [{"category": "x", "present": true}]}\n```'
    assert [len(c) if c else c for c in values(spark, [answer, "no json"], "s string", text.parse_checks(F.col("s")))] == [1, None]
    book = {"cells": [{"cell_type": "code", "source": ["a = 1\n", "%magic\n"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "!ls\nb"}]}
    got = values(spark, [json.dumps(book)], "s string", text.notebook_source(F.col("s")))[0]
    assert got == "a = 1\n# [magic] %magic\n\n# --- cell boundary ---\n\n# [magic] !ls\nb"
    assert values(spark, ["exec python3 -u -O x/run.py", "python -m a.b", "echo"], "s string", text.shell_python(F.col("s"))) == [(None, "x/run.py"), ("a.b", None), (None, None)]


def test_categories_and_facts(spark):
    rows = [("r", "bandit", "B301", "high", "training"), ("r", "Bandit", "B507", "", "x"), ("r", "semgrep", "other", None, None), ("r", "pip-audit", "CVE", "medium", "dependencies"), ("r", "claude_judgment", "absent_control.input_validation", "medium", "training"), ("r", "claude_judgment", "absent_control.bogus", "medium", "a+training")]
    findings = spark.createDataFrame([(*r, "f.py", 1, "m") for r in rows], "repo string, tool string, rule_id string, severity string, stage string, file_path string, line int, message string")
    facts = attribution.fact_table(findings, dims.rule_dim(spark)).collect()
    assert [(f.semantic_category, f.severity, f.severity_source, f.stages, f.n_stages, f.scope) for f in facts] == [
        ("insecure_deserialization", "high", "bandit_rule", "training", 1, "pipeline"),
        ("", "unknown", "bandit_rule", "", 0, "out_of_scope"),
        ("", "unknown", "semgrep_rule", "", 0, "out_of_scope"),
        ("vulnerable_dependency", "medium", "pip_audit", "", 0, "dependencies"),
        ("input_validation", "medium", "policy", "training", 1, "pipeline"),
        ("", "medium", "policy", "training", 1, "pipeline"),
    ]
    audit = {r.rule_id: r.assigned_category for r in matrix.rule_audit(attribution.categorize(findings, dims.rule_dim(spark)), F.lit(1)).collect()}
    assert audit["B507"] == "(dropped)" and audit["other"] == "(unmapped)"


def test_matrices_conserve_mass(spark):
    rnd = random.Random(0)
    labels = ["training", "evaluation+training", "data_acquisition+inference+modeling", "dependencies", "unknown", ""]
    rows = [(rnd.choice(labels), rnd.choice([*dims.STATIC_CATEGORIES[:4], None])) for _ in range(200)]
    findings = spark.createDataFrame(rows, "stage string, category string")
    mapped = [r for r in rows if r[1]]
    for mode in stages.MODES:
        table = {r.stage: r for r in matrix.static_matrix(findings, mode).collect()}
        assert list(table) and len(table) == 9
        for c in dims.STATIC_CATEGORIES:
            assert abs(sum(r[c] for s, r in table.items() if s != "total") - table["total"][c]) < 1e-9
        expected = sum(1 if mode != "expand" else max(1, s.count("+") + 1) for s, _ in mapped)
        assert abs(table["total"].total - expected) < 1e-9


def log_rows(spark, rows):
    return spark.createDataFrame([(k, s, a, b) for k, s, a, b in rows], "repo_norm string, status string, source_no int, line_no long")


def test_merging(spark):
    rows = log_rows(spark, [("a", "ok", 1, 0), ("a", "no_entry", 0, 5), ("b", "clone_failed", 0, 1), ("b", "clone_failed", 0, 2), ("c", "clone_failed", 0, 3), ("c", "ok", 1, 1), ("c", "error", 1, 2)])
    assert {(r.repo_norm, r.status) for r in merging.first_per_key(rows, ["repo_norm"]).collect()} == {("a", "no_entry"), ("b", "clone_failed"), ("c", "clone_failed")}
    assert {(r.repo_norm, r.line_no) for r in merging.settle_retries(rows, ["repo_norm"]).collect()} == {("a", 5), ("b", 2), ("c", 1)}
    base = log_rows(spark, [("a", "no_entry", 0, 0), ("b", "ok", 0, 1), ("c", "clone_failed", 0, 2), ("e", "no_dockerfile", 0, 3)])
    again = log_rows(spark, [("a", "ok", 1, 0), ("b", "no_entry", 1, 1), ("c", "ok", 1, 2), ("d", "error", 1, 3)])
    got = {r.repo_norm: (r.status, r.overlay_source, r.pass1_status, r.pass2_status) for r in merging.overlay(base, again).collect()}
    assert got == {"a": ("ok", "pass2", "no_entry", None), "b": ("ok", "pass1", None, "no_entry"), "c": ("clone_failed", "pass1", None, "ok"), "d": ("error", "pass2", None, None), "e": ("no_dockerfile", "pass1", None, None)}
    assert [r.repo_norm for r in merging.not_done(base, [again]).collect()] == ["e"]
    assert {(r.repo_norm, r.side) for r in merging.coverage(base, again, "repo_norm").collect()} == {("e", "left"), ("d", "right")}
    assert [r.repo_norm for r in merging.failed_once(base).orderBy("repo_norm").collect()] == ["a", "e"]


@pytest.mark.parametrize("values_", [[10, 20, 20, 30], [5, 5, 5], [1], [3.5, None, 3.5, -1]])
def test_average_ranks(spark, values_):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values_)], "i long, v double")
    got = {r.i: r.avg_rank for r in ordering.average_ranks(df, "v").collect()}
    for i, v in enumerate(values_):
        same = [x for x in values_ if x == v and x is not None]
        below = [x for x in values_ if x is not None and v is not None and x < v]
        assert got[i] == (None if v is None else len(below) + (len(same) + 1) / 2)


def test_row_numbers_and_shards(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    assert all(r.n == r.k + 1 for r in ordering.row_numbers(df, ["k"], "n").collect())
    assert all(r.shard == r.k % 6 for r in sampling.round_robin(df, 6, ["k"]).collect())


def test_correlations(spark):
    rnd = random.Random(1)
    rows = [(str(i), i % 7, rnd.randrange(5), 1) for i in range(40)] + [(f"x{i}", None, 1, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "repo string, stars long, findings_total long, constant long")
    got = {(r.predictor, r.outcome): r for r in statistics.correlation_table(df, predictors=("stars", "constant"), outcomes=("findings_total",)).collect()}
    used = [(a, b) for _, a, b, _ in rows if a]
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    x, y = rank([a for a, _ in used]), rank([b for _, b in used])
    mx, my = sum(x) / len(x), sum(y) / len(y)
    rho = sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert got["stars", "findings_total"].n_repos == len(used) and abs(got["stars", "findings_total"].rho - rho) < 1e-12
    assert got["constant", "findings_total"].rho is None
    assert statistics.correlation_table(df.limit(9), predictors=("stars",), outcomes=("findings_total",)).collect() == []


@pytest.mark.parametrize("pairs, n, agree, k", [([], 0, None, None), ([(1, 1)] * 3, 3, 100.0, 1.0), ([(1, 1), (1, 0)], 2, 50.0, 0.0), ([(1, 1), (0, 0), (1, 0), (0, 1)], 4, 50.0, 0.0), ([(1, 1), (0, 0), (1, None)], 2, 100.0, 1.0)])
def test_kappa(spark, pairs, n, agree, k):
    df = spark.createDataFrame([tuple(None if x is None else bool(x) for x in p) for p in pairs], "a boolean, b boolean")
    r = df.agg(*statistics.kappa(F.col("a"), F.col("b"))).first()
    assert (r.n, r.agreement_pct, r.cohens_kappa) == (n, agree, k)


def test_stratified_sample(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(3)] + [("c", 0)], "s string, i long")
    for n, per in ((30, 10), (9, 3), (1, 1)):
        got = [r.s for r in sampling.stratified_sample(df, ["s"], n, F.md5(F.col("i").cast("string").cast("binary"))).collect()]
        assert [got.count(x) for x in "abc"] == [min(per, 50), min(per, 3), 1]
    assert sampling.stratified_sample(df.limit(0), ["s"], 5, F.col("i")).collect() == []


@pytest.mark.parametrize("last, cut", [(800, False), (801, True)])
def test_budget(spark, last, cut):
    # headers of 10 characters; 1000 - 2 * 310 = 380 characters are left for the third
    texts = ["a" * 300, "b" * 300, "c" * last, "d"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k long, i long, t string")
    for budget, least in ((1000, 200), (820, 200), (821, 200)):
        got = sampling.budget_concat(df, ["k"], ["i"], F.lit("h" * 10), F.col("t"), per_item=800, budget=budget, least=least).first().text
        left = budget - 620
        chunk = "h" * 10 + ("c" * last if last <= 800 else "c" * 800 + f"\n# ... (file truncated, original {last} chars) ...\n")
        tail = chunk[:left] + "\n# ... (slice truncated) ...\n" if left > least else ""
        assert got == "h" * 10 + texts[0] + "h" * 10 + texts[1] + tail
    whole = sampling.budget_concat(df, ["k"], ["i"], F.lit("h" * 10), F.col("t"), per_item=800, budget=10_000).first().text
    assert whole.endswith("h" * 10 + "d") and ("file truncated" in whole) == cut


SIGNALS = [("s", "pd.read_csv"), ("s", ".fit"), ("s", "tf.keras.layers.*"), ("s", "train_test_split"), ("t", ".*"), ("t", "layers")]
CALLS = ["pd.read_csv", "x.pd.read_csv", "pandas.read_csv", "sklearn.model_selection.train_test_split", "x.fit", "fit", "x.fit_predict", "tf.keras.layers.Dense", "tf.keras.layers", "tf.keras.layersX.a", "myModel"]


def slow_match(call, pattern):
    if pattern.endswith(".*"):
        return call.startswith(pattern[:-1])
    return call == pattern.lstrip(".") or call.endswith(pattern if pattern.startswith(".") else "." + pattern)


def test_signals(spark):
    calls = spark.createDataFrame([(c,) for c in CALLS], "call string")
    got = {(r.call, r.stage): r.pattern for r in matching.match_signals(calls, dims.signal_dim(spark, [s for s in SIGNALS if s[1] != ".*"]), []).collect()}
    want = {}
    for stage, pattern in reversed([s for s in SIGNALS if s[1] != ".*"]):
        want |= {(c, stage): pattern for c in CALLS if slow_match(c, pattern)}
    assert got == want


def test_reachability(spark):
    chain = [("r", f"n{i}", f"n{i + 1}") for i in range(30)]
    edges = spark.createDataFrame([*chain, ("r", "n3", "n0"), ("r", "n2", "bad"), ("r", "bad", "far"), ("q", "n0", "z")], "repo string, src string, dst string")
    seeds = spark.createDataFrame([("r", "n0"), ("r", "n5")], "repo string, node string")
    closed = spark.createDataFrame([("r", "bad")], "repo string, node string")
    got = {r.node: r.depth for r in graph.reachability(seeds, edges, 6, closed).collect()}
    assert got == {**{f"n{i}": i for i in range(5)}, **{f"n{i}": i - 5 for i in range(5, 12)}, "bad": 3}
    seeds.createOrReplaceTempView("s"), edges.createOrReplaceTempView("e")
    assert {r.node: r.depth for r in spark.sql(graph.reachability_sql("s", "e", 4)).collect()} == {r.node: r.depth for r in graph.reachability(seeds, edges, 4).collect()}


@pytest.mark.parametrize(
    "content, kind, target, workdir",
    [
        ('CMD ["python", "-u", "src/run.py"]', "python_file", "src/run.py", "/"),
        ("WORKDIR '/srv'\nWORKDIR app\nCMD python train.py", "python_file", "train.py", "/srv/app"),
        ("CMD python \\\n  -m a.b", "python_module", "a.b", "/"),
        ("CMD python -u -m a.b", "unresolved", None, "/"),
        ("CMD bash run.sh", "shell_script", "run.sh", "/"),
        ("ENTRYPOINT ['/usr/bin/python3']\nCMD ['x.py']", "python_file", "x.py", "/"),
        ("CMD ./start.sh\n# CMD python a.py", "shell_script", "./start.sh", "/"),
        ("cmd python a.py\nCMD node b.js", "unresolved", None, "/"),
        ("FROM x", "unresolved", None, "/"),
        ("CMD python 'unclosed.py", "python_file", "'unclosed.py", "/"),
    ],
)
def test_dockerfiles(content, kind, target, workdir):
    command = parsing.dockerfile_command(content)
    assert (*parsing.classify_command(command["tokens"]), command["workdir"]) == (kind, target, workdir)


SOURCE = "np.a()\nimport numpy\nimport torch.nn\nfrom pandas import read_csv as rc\nfrom ..x import y\nfrom . import *\nnp.b(); rc(); torch.no_grad(); y.z(); f()(); f().g.h()\nclass M(torch.nn.Module): pass\nclass N(object): pass\nasync def g(): numpy.c(rc())"


def test_module_events(spark):
    files = spark.createDataFrame([("r", "a.py", SOURCE), ("r", "b.py", "def ("), ("r", "c.py", None)], "repo string, path string, content string")
    modules = parsing.parse_modules(files)
    errors = {r.path: r.parse_error for r in modules.collect()}
    assert errors["a.py"] is None and errors["b.py"].startswith("syntax error: ") and errors["c.py"] is None
    assert [(r.call, r.line) for r in parsing.calls_of(modules).orderBy("pos").collect()] == [("np.a", 1), ("np.b", 7), ("pd.read_csv", 7), ("nn.no_grad", 7), ("x.y.z", 7), ("f", 7), ("g.h", 7), ("f", 7), ("np.c", 10), ("pd.read_csv", 10)]
    assert sorted((r.module, r.level) for r in parsing.imports_of(modules).collect()) == [("", 1), ("numpy", 0), ("pandas", 0), ("torch.nn", 0), ("x", 2)]
    assert [r.name for r in parsing.models_of(modules).collect()] == ["M"] and [(r.name, r.line) for r in parsing.functions_of(modules).collect()] == [("g", 10)]


def test_later_bindings_count(spark):
    files = spark.createDataFrame([("r", "a.py", "import numpy as x\nx.a()\nimport pandas as x\nx.b()\ndef f():\n    from torch.nn import functional as x\n    x.c()\nx.d()")], "repo string, path string, content string")
    assert [r.call for r in parsing.calls_of(parsing.parse_modules(files)).orderBy("pos").collect()] == ["np.a", "pd.b", "nn.functional.c", "nn.functional.d"]


def test_import_candidates(spark):
    rows = [("r", "a/b/c.py", "x.y", 0), ("r", "a/b/c.py", "m", 1), ("r", "a/b/c.py", "m", 2), ("r", "a/b/c.py", "", 1)]
    df = spark.createDataFrame(rows, "repo string, src string, module string, level int")
    got = {}
    for r in graph.import_candidates(df).collect():
        got.setdefault((r.module, r.level), []).append(r.path)
    assert got == {("x.y", 0): ["x/y.py", "x/y/__init__.py", "y.py", "y/__init__.py"], ("m", 1): ["a/b/m.py", "a/b/m/__init__.py"], ("m", 2): ["a/m.py", "a/m/__init__.py"], ("", 1): ["a/b.py", "a/b/__init__.py"]}


def test_tool_reports(spark):
    reports = {
        "semgrep": {"results": [{"check_id": "c", "path": "/w/a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": " m ", "lines": "x" * 500}}]},
        "pip_audit": {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "V", "description": "d", "fix_versions": ["2", "3"]}, {"id": "W", "description": "", "fix_versions": []}]}, {"name": "q", "version": "2", "vulns": []}]},
        "modelscan": {"issues": [{"severity": "CRITICAL", "description": "os", "operator": "system"}]},
        "gitleaks": [{"RuleID": "g", "File": "/w/b", "StartLine": 2, "Match": "k"}],
        "nbdefense": {"issues": [{"severity": "low", "id": "n", "path": "/w/c", "cell": 4, "description": "z"}]},
    }
    expected = {
        "semgrep": [("high", "c", "a.py", 3, "m", "x" * 400)],
        "pip_audit": [("medium", "V", "req.txt", 0, "p 1: d (fix: 2, 3)", "p==1"), ("medium", "W", "req.txt", 0, "p 1:  (fix: no fix listed)", "p==1")],
        "modelscan": [("high", "os", "req.txt", 0, "os", "system")],
        "gitleaks": [("high", "g", "b", 2, "leaked secret", "k")],
        "nbdefense": [("low", "n", "c", 4, "z", "")],
    }
    for tool, report in reports.items():
        df = spark.createDataFrame([("r", "/w", "req.txt", json.dumps(report)), ("r", "/w", "req.txt", "broken{")], "repo string, root string, file string, report string")
        rows = tools.ADAPTERS[tool](df).collect()
        assert [(r.severity, r.rule_id, r.file_path, r.line, r.message, r.snippet) for r in rows] == expected[tool], tool


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "log.csv").write_text('repo,status,detail\nhttps://h/o/n/,ok,"two\nlines ""quoted"""\n,ok,x\nhttps://h/a/b,,y\n')
    (tmp_path / "new.csv").write_text("repo,status,entry_route\nhttps://h/c/d,ok,\n")
    rows = readers.read_scan_logs(spark, [str(tmp_path / "log.csv"), str(tmp_path / "new.csv")]).orderBy("source_no").collect()
    assert [(r.repo, r.detail, r.widened) for r in rows] == [("https://h/o/n/", 'two\nlines "quoted"', False), ("https://h/c/d", None, True)]
    assert readers.read_scan_log(spark, str(tmp_path / "absent.csv")).collect() == []
    (tmp_path / "list.txt").write_text("# c\no/n\n\nhttp://x/y\no/n\n")
    assert {r.repo for r in readers.read_candidates(spark, str(tmp_path / "list.txt")).collect()} == {"https://github.com/o/n", "http://x/y"}
    folder = tmp_path / "findings"
    folder.mkdir()
    (folder / "o__n.json").write_text(json.dumps([{"tool": "bandit", "line": 3}, {"tool": "semgrep", "line": 0}], indent=2))
    (folder / "a__b.json").write_text("[]")
    (folder / "c__d.json").write_text("{broken")
    found = readers.read_findings(spark, str(folder)).collect()
    assert sorted((r.repo, r.tool, r.line) for r in found) == [("https://github.com/o/n", "bandit", 3), ("https://github.com/o/n", "semgrep", 0)]
    snaps = tmp_path / "snaps"
    snaps.mkdir()
    (snaps / "o__n.json").write_text(json.dumps({"repo": "o/n", "reachable_files": ["a.py"], "stages_with_files": {"training": ["a.py"]}}))
    shots = readers.read_snapshots(spark, str(snaps))
    assert readers.snapshot_stage_files(shots, "training").first().files == ["a.py"]
    assert readers.snapshot_stage_files(shots, "other").first().files == []
    out = str(tmp_path / "out")
    findings = spark.createDataFrame([("k1", "a"), ("k2", "b")], "repo_key string, tool string")
    writers.write_per_repository(findings, out)
    writers.write_per_repository(findings.filter("repo_key = 'k1'").withColumn("tool", F.lit("c")), out)
    assert {(r.repo_key, r.tool) for r in spark.read.json(out).collect()} == {("k1", "c"), ("k2", "b")}
    assert writers.with_fields(findings, ["tool", "missing"]).first().asDict() == {"tool": "a", "missing": ""}
    tree = tmp_path / "tree" / "repo1" / "sub"
    tree.mkdir(parents=True)
    (tree / "Dockerfile").write_text("FROM x")
    files = readers.read_tree(spark, str(tmp_path / "tree"))
    assert [(r.repo, r.path) for r in readers.find_dockerfiles(files).collect()] == [("repo1", "sub/Dockerfile")]


def test_streams(spark, tmp_path):
    schema = "repo string, status string, ts timestamp, value double"
    t = datetime.datetime(2024, 1, 1)
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = [("a", "ok", t, 1.0), ("b", "clone_failed", t, 2.0), ("a", "ok", t, 3.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    run = lambda: logs.append_new(logs.read_stream(spark, source, schema), log, str(tmp_path / "ck")).awaitTermination(60)
    run()
    spark.createDataFrame([("b", "ok", t, 1.0), ("c", "ok", t, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.repo for r in spark.read.parquet(log).collect()) == ["a", "b", "c"]
    stream = logs.status_counts(logs.read_stream(spark, source, schema), F.col("ts"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.status, r.n) for r in spark.table("counts").collect()} == {("ok", 4), ("clone_failed", 1)}


def test_repository_metrics(spark):
    m = spark.createDataFrame([("a", 5), ("b", None)], "repo string, size_kb long")
    lang = spark.createDataFrame([("a", {"Python": 7, "C": 3})], "repo string, languages map<string, long>")
    commits = spark.createDataFrame([("a", '<x?page=9>; rel="last"')], "repo string, link string")
    rows = {r.repo: tuple(r)[1:] for r in tools.repository_extras(m, lang, commits).collect()}
    assert rows == {"a": (9, 5, 7, 10, True), "b": (None, None, None, None, False)}


def test_finding_schema_matches_reader(spark):
    assert spark.createDataFrame([], schemas.FINDING).columns[:3] == ["tool", "severity", "rule_id"]
