"""Repository scans over a small built-in source tree, tool reports, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims, schemas
from ..operators import graph, parsing, tools
from ..streaming import logs as streams
from .registry import query, table

#: A small tree with Dockerfiles of all forms, imports of all kinds, and a notebook.
TREE = {
    ("app", "Dockerfile"): "FROM python\n# comment\nWORKDIR /srv\nRUN pip install \\\n    torch\nENTRYPOINT [\"python\", \"-u\"]\nCMD [\"src/run.py\", \"--fast\"]\n",
    ("app", "docker/gpu.Dockerfile"): "FROM x\nCMD bash start.sh\n",
    ("app", "start.sh"): "#!/bin/sh\nset -e\nexec python -O -m pkg.serve --port 1\n",
    ("app", "src/run.py"): "import pandas as panda\nfrom . import train\nimport pkg.serve\n\ndef main():\n    x = panda.read_csv('a')\n    return train.fit(x)\n\nmain()\n",
    ("app", "src/train.py"): "import torch.nn as net\nfrom sklearn.model_selection import train_test_split as split\n\nclass Net(net.Module):\n    def training_step(self, b):\n        return split(b)\n\ndef fit(x):\n    return Net().fit(x)\n",
    ("app", "pkg/__init__.py"): "",
    ("app", "pkg/serve.py"): "import importlib\nfrom .broken import x\nmodel = importlib.import_module('m')\nmodel.predict(1)\n",
    ("app", "pkg/broken.py"): "def (\n",
    ("app", "pkg/unused.py"): "import os\n",
    ("lib", "setup.cfg"): "[options.entry_points]\nconsole_scripts =\n    tool = lib.cli:main\n",
    ("lib", "lib/cli.py"): "from lib.core import go\ngo()\n",
    ("lib", "lib/core.py"): "from lib import cli\n\ndef go():\n    print(eval('1'))\n",
    ("lib", "Dockerfile"): "FROM x\nRUN true\n",
    ("flat", "main.py"): "import missing\nimport helper\nhelper.evaluate()\n",
    ("flat", "helper.py"): "import main\n",
    ("none", "README.md"): "nothing here",
}

SIGNALS = [("data_acquisition", "pd.read_csv"), ("data_acquisition", "open"), ("data_preparation", "train_test_split"), ("modeling", "nn.*"), ("training", ".fit"), ("evaluation", ".evaluate"), ("inference", ".predict")]
KINDS = ("app", "lib", "flat", "none")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One repository for each document: one of the kinds above, with the document's text as one more file."""
    built = spark.createDataFrame([(KINDS.index(r), p, c) for (r, p), c in TREE.items()], "kind int, path string, content string")  # a few files
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("repo"), (F.col("doc_id") % len(KINDS)).cast("int").alias("kind"), "text")
    files = docs.select("repo", "kind").join(F.broadcast(built), "kind").select("repo", "path", "content")
    return files.union(docs.select("repo", F.lit("docs/text.md"), "text"))


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, bool)) else "[" + ", ".join(map(quoted, x)) + "]" if isinstance(x, list) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


def _for_each(columns: str, rows: list[tuple], select: str) -> str:
    """SQL for ``rows`` (the kind of repository first) once for every document of that kind."""
    return f"WITH k(kind, {columns}) AS (VALUES {_values([(KINDS.index(r[0]), *r[1:]) for r in rows])}) SELECT CAST(doc_id AS VARCHAR) AS repo, {select} FROM documents JOIN k ON kind = doc_id % {len(KINDS)}"


@query(
    _for_each(
        "docker_path, entry_kind, entry_file, module, route, note",
        [
            ("app", "Dockerfile", "python_file", "src/run.py", None, "dockerfile", None),
            ("app", "docker/gpu.Dockerfile", "python_module", "pkg/serve.py", "pkg.serve", "dockerfile", "module pkg.serve is pkg/serve.py"),
            ("lib", "Dockerfile", "unresolved", None, None, "dockerfile", "neither CMD nor ENTRYPOINT"),
            ("lib", "(fallback)", "python_file", "lib/cli.py", None, "fallback_console_script", "setup.cfg declares a script in lib.cli"),
            ("flat", "(fallback)", "python_file", "main.py", None, "fallback_root", "main.py at the repository root"),
        ],
        "docker_path, entry_kind AS kind, entry_file, module, route, note",
    )
)
def docker_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.entry_points(trees(spark, sf_dir))


@query(
    _for_each(
        "path, call, line",
        [
            ("app", "pkg/serve.py", "importlib.import_module", 3), ("app", "pkg/serve.py", "model.predict", 4), ("app", "src/run.py", "pd.read_csv", 6), ("app", "src/run.py", "train.fit", 7), ("app", "src/run.py", "main", 9),
            ("app", "src/train.py", "sklearn.model_selection.train_test_split", 6), ("app", "src/train.py", "fit", 9), ("app", "src/train.py", "Net", 9),
            ("lib", "lib/cli.py", "lib.core.go", 2), ("lib", "lib/core.py", "print", 4), ("lib", "lib/core.py", "eval", 4), ("flat", "main.py", "helper.evaluate", 3),
        ],
        "path, call, line",
    )
)
def ast_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.calls_of(parsing.parse_modules(trees(spark, sf_dir).filter("path like '%.py'"))).select("repo", "path", "call", "line")


@query(
    _for_each(
        "status, entry_route, entry_files, reachable_files, total_functions, max_depth, parse_errors, dynamic_imports, stages_present, verified, detail",
        [
            ("app", "ok", "dockerfile", ["pkg/serve.py", "src/run.py"], 3, 1, 1, 1, 1, 3, False, "missing: data_preparation, modeling, evaluation"),
            ("lib", "ok", "dockerfile+fallback_console_script", ["lib/cli.py"], 2, 1, 1, 0, 0, 0, False, "missing: data_acquisition, data_preparation, modeling, training, evaluation, inference"),
            ("flat", "ok", "fallback_root", ["main.py"], 2, 0, 1, 0, 0, 1, False, "missing: data_acquisition, data_preparation, modeling, training, inference"),
        ],
        "status, entry_route, entry_files, reachable_files, total_functions, max_depth, parse_errors, dynamic_imports, stages_present, verified, detail",
    )
)
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parsing.scan_repositories(trees(spark, sf_dir), dims.signal_dim(spark, SIGNALS))["scan"]
    return out.select("repo", "status", "entry_route", "entry_files", "reachable_files", "total_functions", "max_depth", "parse_errors", "dynamic_imports", "stages_present", "verified", "detail")


_APP, _FLAT = ["pkg/serve.py", "src/run.py", "pkg/broken.py"], ["main.py", "helper.py"]


@query(
    _for_each(
        "stage, files",
        [
            *(("app", s, _APP if s in ("data_acquisition", "training", "inference") else []) for s in dims.PIPELINE_STAGES),
            *(("lib", s, []) for s in dims.PIPELINE_STAGES),
            *(("flat", s, _FLAT if s == "evaluation" else []) for s in dims.PIPELINE_STAGES),
        ],
        "stage, CAST(files AS VARCHAR[]) AS files",
    )
)
def audit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = trees(spark, sf_dir)
    scan = parsing.scan_repositories(files, dims.signal_dim(spark, SIGNALS))
    return graph.audit_context(scan["reachable"], scan["presence"], files)


@query(
    """
SELECT CAST(doc_id AS VARCHAR) AS repo, 'bandit' AS tool, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END AS severity, 'B' || (100 + doc_id % 700) AS rule_id, 'src/' || lang || '.py' AS file_path, n_chars AS line, trim(substring(trim(text), 1, 400)) AS snippet
FROM documents WHERE doc_id % 3 <> 2"""
)
def tool_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one scanner, written as JSON from documents and read back; every third finding lies below the severity floor."""
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    severity = F.when(n % 3 == 0, "CRITICAL").when(n % 3 == 1, "Moderate").otherwise("LOW")
    result = F.struct(severity.alias("issue_severity"), F.concat(F.lit("B"), (100 + n % 700).cast("string")).alias("test_id"), F.concat(F.lit("/work/x/src/"), "lang", F.lit(".py")).alias("filename"), F.col("n_chars").cast("int").alias("line_number"), F.lit("message").alias("issue_text"), F.col("text").alias("code"))
    reports = docs.select(n.cast("string").alias("repo"), F.lit("/work/x").alias("root"), F.lit("").alias("file"), F.to_json(F.struct(F.array(result).alias("results"))).alias("report"))
    out = tools.ADAPTERS["bandit"](reports)
    return out.select("repo", "tool", "severity", "rule_id", "file_path", F.col("line").cast("long").alias("line"), "snippet")


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS status, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts: the batch form of ``streaming.logs.status_counts``, which takes streams too."""
    rows = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("status"), "value")
    out = streams.status_counts(rows, F.col("ts"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "status", "n", F.round("total", 4).alias("total"))


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.sessions(table(spark, sf_dir, "events"), F.col("ts"), "user_id", "6 hours")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")
