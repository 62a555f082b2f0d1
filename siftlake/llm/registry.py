"""Queries that bind the operators of this subpackage to the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, url_filter
from .chat_format import MarkedTurns, format_conversations, read_back
from .common import table
from .decontaminate import scan_documents
from .line_dedup import LINK_CHARS, dedup_report
from .perplexity import quality_rules
from .piece_codec import encode_decode
from .pipeline import run as run_pipeline
from .quality_qda import quality_scores
from .sharding import shard_documents
from .simhash import near_duplicates
from .token_counts import token_counts


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, turn, role, chat_format.HOSTILE) for turn, role in enumerate(("user", "assistant"))], rows.schema)
    template = MarkedTurns()
    return read_back(format_conversations(rows.union(added), template), template)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"), min_chars=LINK_CHARS, short_lines=True)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op10_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pipeline(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_token_counts, op4_quality_qda, op5_url_filter, op6_chat_format, op7_decontaminate, op8_line_dedup, op9_sharding, op10_piece_codec, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.oracle(), "op6_chat_format": chat_format.oracle(), "op7_decontaminate": decontaminate.oracle()}
