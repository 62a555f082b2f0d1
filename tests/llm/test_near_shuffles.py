"""What the near-duplicate stage shuffles: few hashes that don't meet, and few pairs that aren't similar."""

import random

import numpy as np
import pytest
from test_corpus_operators import union_find
from test_whole_job import frame, jaccard, shingles

from siftlake.llm import simhash


def long_texts(rnd):
    """Long texts that share a fifth of their words in one passage, and near copies of two of them."""
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = words(400)
    texts = [words(800) + passage + words(800) for _ in range(6)]
    for t in texts[:2]:
        texts.append([*t[:900], "changed", *t[901:]])
    return [" ".join(t) for t in texts]


def test_pairs_that_share_too_little_are_not_verified(spark, monkeypatch):
    texts = long_texts(random.Random(7))
    sets = [shingles(t) for t in texts]
    similar = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    assert sorted(similar) == [(6, 0), (7, 1)]
    asked, verified = [], simhash._verified

    def spy(pairs, *args, **kwargs):
        asked.append(pairs.count())
        return verified(pairs, *args, **kwargs)

    monkeypatch.setattr(simhash, "_verified", spy)
    # no links by fingerprints within three bits, so that only similarity links the copies
    monkeypatch.setattr(simhash, "links", lambda prints: prints.select(prints.fp.alias("u"), prints.fp.alias("v")).limit(0))
    rows = simhash.near_duplicates(frame(spark, texts), width=5, similarity=0.8).collect()
    roots = union_find(len(texts), similar)
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(roots))
    assert 0 < sum(asked) <= len(similar)


@pytest.mark.parametrize("most", [64, 1 << 28])
def test_hashes_of_prefixes_are_found_whole(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "_MAP_BITS", most)
    rng = np.random.default_rng(1)
    prefixes = [[int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, n)] for n in (0, 3, 500, 1, 0, 90)]
    prefixes[1] += [-(1 << 63), (1 << 63) - 1]
    keys = [*prefixes[1], prefixes[2][7], prefixes[2][499], prefixes[5][0], 17]
    prefixes[5].append(prefixes[2][7])
    table = spark.createDataFrame(list(enumerate(prefixes)), "s long, prefix array<long>").repartition(3)
    for known in (keys, []):
        got = simhash._among_prefixes(table, spark.createDataFrame([(k,) for k in known], "key long")).collect()
        want = {(s, k, i) for s, own in enumerate(prefixes) for i, k in enumerate(own) if k in set(known)}
        assert len(got) == len(want) and {(r.s, r.key, r.pos) for r in got} == want


def test_most_other_hashes_are_not_shuffled(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 100_000)
    known = simhash._bitmap(spark.createDataFrame([(int(x),) for x in hashes[:3000]], "key long"))
    found = simhash._marked(known, hashes)
    assert set(range(3000)) <= set(found.tolist()) and len(found) < 0.1 * len(hashes)
    assert known.nbytes <= 3000 * 2 * simhash._BITS_A_KEY / 8
