"""Readers for logs, findings, snapshots, candidate lists and source trees.

A missing path gives an empty table with the right columns.  CSV files are read
with embedded newlines and doubled quotes; every row carries where it came from
(``source_no``, ``line_no``), because tables have no order of their own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalar, text

URL_COLUMNS = ("html_url", "gh_html_url", "url", "repo", "repository")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, *, columns: Iterable[str] = ()) -> DataFrame:
    """All columns as text, plus ``line_no``; empty with ``columns`` if there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), "line_no bigint"]))
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def read_scan_log(spark: SparkSession, path: str, *, require_status: bool = True, source_no: int = 0) -> DataFrame:
    """Rows with a repository (and a status), and whether the file has an ``entry_route`` column at all (``widened``)."""
    rows = read_csv(spark, path, columns=("repo", "status"))
    keep = scalar.blank_to_null(F.col("repo")).isNotNull()
    if require_status:
        keep = keep & scalar.blank_to_null(F.col("status")).isNotNull()
    return rows.filter(keep).withColumns({"source_no": F.lit(source_no), "widened": F.lit("entry_route" in rows.columns)})


def read_scan_logs(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All logs under the union of their headers; what a file lacks is null there."""
    logs = [read_scan_log(spark, p, source_no=i) for i, p in enumerate(paths)]
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``repo, line_no`` from a column of that name, else from the first one; blanks are dropped."""
    rows = read_csv(spark, path, columns=("repo",))
    column = "repo" if "repo" in rows.columns else rows.columns[0]
    return rows.select(F.trim(F.col(f"`{column}`")).alias("repo"), "line_no").filter("repo <> ''")


def read_corpus_rows(spark: SparkSession, path: str) -> DataFrame:
    """One full row for each repository key: the last in the file."""
    rows = read_csv(spark, path, columns=("repo",)).withColumn("repo_key", scalar.repo_key(F.col("repo")))
    names = [c for c in rows.columns if c not in ("repo_key", "line_no")]
    last = rows.groupBy("repo_key").agg(F.max_by(F.struct(*names), "line_no").alias("row"))
    return last.select("repo_key", "row.*")


def read_candidates(spark: SparkSession, path: str, *, expand: bool = True, distinct: bool = True) -> DataFrame:
    """``repo, line_no`` from a spreadsheet, a CSV file or a text file of candidates.

    The first URL-like column counts; in text files ``#`` starts a comment line.
    """
    if path.endswith(".xlsx"):
        import pandas as pd  # a spreadsheet holds at most 2**20 rows

        table = pd.read_excel(path, dtype=str)
        table.columns = [str(c).lower() for c in table.columns]
        rows = spark.createDataFrame(table).withColumn("line_no", F.monotonically_increasing_id())
    elif path.endswith(".csv"):
        rows = read_csv(spark, path)
        rows = rows.toDF(*(c.lower() for c in rows.columns))
    else:
        rows = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')").withColumnRenamed("value", "url").withColumn("line_no", F.monotonically_increasing_id())
    column = next((c for c in URL_COLUMNS if c in rows.columns), None)
    if column is None:
        raise ValueError(f"one of the columns {URL_COLUMNS} is needed")
    value = scalar.expand_repo(F.col(column)) if expand else scalar.normalize_url(F.col(column))
    out = rows.select(value.alias("repo"), "line_no").filter("repo <> ''")
    return out.groupBy("repo").agg(F.min("line_no").alias("line_no")) if distinct else out


def read_json_lists(spark: SparkSession, path: str, schema: str = schemas.FINDING) -> DataFrame:
    """Rows of the JSON arrays in a file or folder, with ``file_key`` (the file's name without ``.json``) and ``ord`` within the file.

    Files that aren't a JSON array of objects give no rows.
    """
    columns = schema + ", _corrupt_record string"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, file_key string, ord bigint")
    rows = spark.read.option("multiLine", True).schema(columns).json(path).withColumns({"file_key": F.regexp_replace(F.col("_metadata.file_name"), r"[.]json$", ""), "ord": F.monotonically_increasing_id()})
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings with ``repo_key`` and ``repo`` taken from the file's name."""
    rows = read_json_lists(spark, path)
    return rows.withColumns({"repo_key": F.col("file_key"), "repo": scalar.key_to_url(F.col("file_key"))}).drop("file_key")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Import snapshots with ``repo_key``; the context files are found under their old name too."""
    rows = read_json_lists(spark, path, schemas.SNAPSHOT)
    return rows.withColumns({"repo_key": F.col("file_key"), "context_files": F.coalesce("rq2_context_files", "stages_with_files")}).drop("file_key", "ord", "rq2_context_files", "stages_with_files")


def snapshot_stage_files(snapshots: DataFrame, stage: str) -> DataFrame:
    """``repo_key, files`` of one stage; an empty list where the snapshot doesn't have it."""
    return snapshots.select("repo_key", F.coalesce(F.try_element_at("context_files", F.lit(stage)), F.array().cast("array<string>")).alias("files"))


def snapshot_reachable(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("repo_key", F.explode("reachable_files").alias("path"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    names = ("stars", "forks", "contributors", "closed_prs", "closed_issues")
    rows = read_csv(spark, path, columns=("repo", *names, "created_at", "pushed_at"))
    age = scalar.elapsed_days(scalar.parse_time(F.col("created_at")), scalar.parse_time(F.col("pushed_at")))
    return rows.select("repo", *(scalar.digits(F.col(n)).alias(n) for n in names), age.alias("age_days"))


def read_loc(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, columns=("repo", "loc_reachable", "clone_ok"))
    return rows.filter("clone_ok = 'True'").select("repo", F.col("loc_reachable").try_cast("long").alias("loc_reachable")).filter("loc_reachable is not null")


def read_extras(spark: SparkSession, path: str) -> DataFrame:
    names = ("commit_count", "size_kb", "python_bytes")
    rows = read_csv(spark, path, columns=("repo", *names, "fetch_ok"))
    return rows.filter("fetch_ok = 'True'").select("repo", *(scalar.digits(F.col(n)).alias(n) for n in names))


def read_done_keys(spark: SparkSession, path: str, column: str = "repo") -> DataFrame:
    """Distinct keys that an earlier run has logged."""
    return read_csv(spark, path, columns=(column,)).select(column).filter(f"`{column}` <> ''").distinct()


def read_tree(spark: SparkSession, path: str, repo_depth: int = 1) -> DataFrame:
    """``repo, path, content`` of the text files below a folder of checked-out repositories."""
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path)
    root = F.lit(path.rstrip("/").split(":")[-1].replace("//", "/") + "/")
    below = F.element_at(F.split(F.regexp_replace("path", "^[a-z]+:/+", "/"), root, 2), -1)
    parts = F.split(below, "/")
    return files.select(F.array_join(F.slice(parts, 1, repo_depth), "/").alias("repo"), F.array_join(F.slice(parts, repo_depth + 1, F.size(parts)), "/").alias("path"), F.decode("content", "UTF-8").alias("content"))


def find_dockerfiles(files: DataFrame) -> DataFrame:
    """``repo, path, rank``: Dockerfiles outside vendored folders, shallow and bare names first."""
    from pyspark.sql import Window

    from .. import dims

    depth = F.size(F.split("path", "/")) - 1
    bare = (F.lower(scalar.base_name(F.col("path"))) != "dockerfile").cast("int")
    found = files.filter(scalar.is_dockerfile(F.col("path")) & ~scalar.in_directory(F.col("path"), dims.SKIP_DIRS))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(depth, bare, F.lower("path"), "path")))


def find_model_files(files: DataFrame, cap: int = 50) -> DataFrame:
    """``repo, path`` of model files, at most ``cap`` for a repository (the first by path)."""
    from pyspark.sql import Window

    skip = (".git", "node_modules", "__pycache__", ".venv", "venv", "env")
    found = files.filter(scalar.is_model_file(F.col("path")) & ~scalar.in_directory(F.col("path"), skip))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("repo").orderBy("path"))).filter(F.col("n") <= cap).select("repo", "path")


def repositories_with_notebooks(files: DataFrame) -> DataFrame:
    return files.filter("lower(path) like '%.ipynb'").select("repo").distinct()


def find_requirements(files: DataFrame) -> DataFrame:
    return files.filter(scalar.is_requirements_file(F.col("path"))).select("repo", "path").distinct()


def notebooks_as_modules(files: DataFrame) -> DataFrame:
    """``repo, path, content`` of notebooks, with their code cells as Python source."""
    return files.filter("lower(path) like '%.ipynb'").select("repo", F.regexp_replace("path", r"(?i)[.]ipynb$", ".py").alias("path"), text.notebook_source(F.col("content")).alias("content"))
