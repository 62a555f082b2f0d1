"""A corpus pipeline in five stages, from raw documents to token ids.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  Each begins with executors' heaps shrunk, as the stages before
it fill them.  All stages but the last return the columns of ``documents``
and drop any others.

Nulls: an id, language or source may be null in every stage.  A null text, like
one without words, fails the first stage's base rules; a later stage that meets
one drops it in line dedup, keeps it as one more empty text in the others.
Rows that repeat get the same verdict from each stage but the third, which keeps one
of them.  An empty table, of documents or of benchmark items, is fine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, materialize, slim, table
from .decontaminate import scan_documents
from .line_dedup import LINK_CHARS, dedup_lines
from .perplexity import quality_rules
from .piece_codec import encode_decode
from .simhash import near_classes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Jaccard similarity of five-word shingles from which two documents are near-duplicates.
SIMILARITY = 0.8

#: SQL cannot express perplexities, line links or token ids; tests hold run() against a brute-force version.
ORACLE_SQL = None


def _with_length(docs: DataFrame) -> DataFrame:
    """``documents`` columns with ``n_chars`` of the text as it is now."""
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's perplexity band go.

    The verdict depends on language and text alone, so what goes is named by their hashes.
    """
    slim(spark)
    content = {"h1": F.xxhash64("text"), "h2": F.hash("text", "lang"), "h3": F.coalesce(F.length("text"), F.lit(-1))}
    judged = quality_rules(docs.withColumns(content), keep=tuple(content)).filter("not kept")
    goes = bounded(materialize(judged.select(*content).distinct()))
    return docs.withColumns(content).join(goes, list(content), "left_anti").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, up to the edit threshold, go; so do documents of which nothing but white space is left."""
    slim(spark)
    return _with_length(dedup_lines(docs, min_chars=LINK_CHARS, short_lines=True)).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, null last; of rows that repeat id and text, one.

    A document is an id with a text, named by the id and the text's hashes: an id may be null or have several texts.
    """
    slim(spark)
    content = {"h1": F.xxhash64("text"), "h2": F.hash("text"), "h3": F.coalesce(F.length("text"), F.lit(-1))}
    key = ("doc_id", *content)
    named = docs.select(*COLUMNS).withColumns(content)
    groups = materialize(near_classes(named, keep=key, width=5, similarity=SIMILARITY).groupBy("root", *key).agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull(), *key)
    first = materialize(groups.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n_documents")).filter("n_documents > 1").select("root", "first"))
    marked = groups.join(first, "root", "left").withColumn("goes", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(order))
    known = materialize(marked.filter("goes or n > 1").select(*(F.col(k).alias(f"_{k}") for k in key), "goes"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for k in content:
        same = same & (F.col(k) == F.col(f"_{k}"))
    left = named.join(bounded(known.filter("goes")), same, "left_anti")
    repeated = materialize(known.filter("not goes"))
    if repeated.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(bounded(repeated), same, "left_semi").dropDuplicates(list(key))
    return left.join(bounded(repeated), same, "left_anti").unionByName(once).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    slim(spark)
    found = scan_documents(docs, table(spark, sf_dir, "benchmark"), keep=("doc_id", "lang", "source"), with_text=True)
    return _with_length(found.filter("not over_coverage").withColumnRenamed("clean_text", "text"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with begin and end ids, and a digest of what they decode to."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=COLUMNS, outputs=("n_tokens", "ids", "decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("piece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
