"""What the near-duplicate stage sends to the driver."""

import random

import pytest
from pyspark.sql import DataFrame
from test_whole_job import SCHEMA, near_copies

from siftlake.llm import pipeline, simhash
from siftlake.storage import BROADCAST_ROWS


def test_near_duplicate_stage_holds_no_large_table_in_the_driver(spark, monkeypatch):
    asked = []
    bounded, collect = simhash.bounded, DataFrame.collect

    def spy(df, rows=BROADCAST_ROWS):
        asked.append((rows, {kind for _, kind in df.dtypes}))
        return bounded(df, rows)

    def few(df):
        rows = collect(df)
        if df.columns == ["key"]:
            pytest.fail(f"{len(rows)} hashes as Python rows")
        return rows

    monkeypatch.setattr(simhash, "bounded", spy)
    monkeypatch.setattr(DataFrame, "collect", few)
    # every hash that two sets share counts as frequent, so that all rounds run
    monkeypatch.setattr(simhash, "_PAIRS_A_ROW", 0)
    monkeypatch.setattr(simhash, "_HOT", 1)
    monkeypatch.setattr(simhash, "_PAIRS_A_ROW_AFTER", 0)
    texts = near_copies(random.Random(5), 8)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    assert pipeline.near_duplicate_stage(spark, docs, "").count() < len(texts)
    assert len(asked) > 8 and all(rows <= BROADCAST_ROWS for rows, _ in asked)
    assert not any(kind.startswith("array") for _, kinds in asked for kind in kinds)
