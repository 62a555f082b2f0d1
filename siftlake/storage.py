"""What executors share: intermediate tables, and this package's code."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row count of a DataFrame that is hinted to broadcast.
BROADCAST_ROWS = 100_000

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a temporary folder when it is unset in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="siftlake-"))
        named = sc.getCheckpointDir()
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors.  It is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/siftlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes as a table; the tables that it wrote on the way are removed, and shuffle files that nothing refers to any more with them; executors' heaps shrink."""
    start = len(_scratch)
    out = materialize(build())
    done, _scratch[start:] = _scratch[start:-1], _scratch[-1:]
    for spark, path in done:
        _remove(spark, path)
    sweep(out.sparkSession)
    slim(out.sparkSession)
    return out


def sweep(spark: SparkSession) -> None:
    """Let shuffle files and broadcasts go that nothing refers to any more, at once instead of when the driver's heap fills up."""
    gc.collect()
    spark._jvm.System.gc()


def slim(spark: SparkSession) -> None:
    """Let the executors' heaps shrink to what is in use: Python workers run beside them and need the room.

    A heap that shuffles have filled keeps its size until a full collection, which an executor with room in its heap doesn't begin of itself.
    There is a task for each core, so that every executor of an idle cluster gets some; one that gets none keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _scratch:
        try:
            _remove(spark, path)
        except Exception:  # the JVM may already be gone at exit
            return


def on_workers(df: DataFrame) -> DataFrame:
    """``df``, once its Python workers can import this package: it is sent to the executors at the first call in an application.

    Texts may be long, so Arrow batches get fewer rows than Spark's default unless the session names a number.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(_BATCH_ROWS, "2000")
    if not getattr(sc, "_has_siftlake", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="siftlake-code-"), "siftlake-code"), "zip", os.path.dirname(package), os.path.basename(package))
        sc.addPyFile(archive)
        sc._has_siftlake = True
    return df


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint ``df`` to broadcast if a count proves that it has at most ``rows`` rows; else keep Spark from doing so."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint joins with ``df`` to shuffle.

    Spark takes a table for as large as its compressed files, and no larger after an explode, so it may broadcast one that has many times its bound.
    """
    return df.hint("merge")
