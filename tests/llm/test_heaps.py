"""Executors' heaps shrink before Python workers need the room beside them."""

import re

import public_tokenizers
import pytest
from test_whole_job import SCHEMA

from siftlake import storage
from siftlake.llm import piece_codec, pipeline


class Slim(Exception):
    pass


def stop(spark):
    raise Slim


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))


def test_executors_collect_all_garbage(spark):
    before = full_collections(spark)
    storage.slim(spark)
    assert full_collections(spark) >= before + spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("k", range(len(pipeline.STAGES)))
def test_each_stage_begins_with_small_heaps(spark, monkeypatch, k):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7)], SCHEMA)
    monkeypatch.setattr(pipeline, "slim", stop)
    monkeypatch.setattr(piece_codec, "slim", stop)
    with pytest.raises(Slim):
        pipeline.STAGES[k][1](spark, docs, "")


def test_tables_are_built_and_heaps_shrunk(spark, monkeypatch):
    monkeypatch.setattr(storage, "slim", stop)
    with pytest.raises(Slim):
        storage.settled(lambda: spark.range(3))


def test_encoding_is_unchanged(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7), (2, None, "en", "s", 0)], SCHEMA)
    rows = piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "decoded")).collect()
    assert {r.doc_id: r.decoded for r in rows} == {1: "one two", 2: ""}
