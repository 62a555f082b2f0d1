"""What the near-duplicate stage holds in a Python worker."""

import tracemalloc
import uuid

import numpy as np

from siftlake.llm import simhash


def test_frequent_hashes_are_looked_up_without_a_copy_of_them():
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 1 << 20))
    own = np.unique(np.concatenate((rng.choice(known, 300), rng.integers(-(1 << 63), (1 << 63) - 1, 3000), [-(1 << 63), (1 << 63) - 1])))
    want = np.isin(own, known)
    tracemalloc.start()
    try:
        got = simhash._among(own, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (got == want).all() and 300 <= got.sum()
    assert peak < known.nbytes / 8
    assert not simhash._among(own, known[:0]).any() and not len(simhash._among(own[:0], known))


def test_workers_give_memory_back_after_each_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "trim", lambda: (tmp_path / uuid.uuid4().hex).touch())
    docs = spark.createDataFrame([(f"one two three four five six {i % 7}",) for i in range(40)] + [(None,), ("",)], "text string").repartition(2)
    for made in (simhash._shingle_sets(docs, 5, "text"), simhash._extensions(docs, np.array([5], dtype=np.int64), width=5, similarity=0.8, text_column="text")):
        made.collect()
        left = list(tmp_path.iterdir())
        assert len(left) == 2
        for path in left:
            path.unlink()
