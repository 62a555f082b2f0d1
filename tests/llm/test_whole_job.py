"""Places where an operator once did less than the whole job."""

import random
import zlib
from collections import defaultdict

import pytest
from test_corpus_operators import WORD, frame, slow_fingerprint, union_find

from siftlake.llm import pipeline, simhash
from siftlake.llm.registry import op8_line_dedup
from siftlake.llm.sharding import shard_documents
from siftlake.llm.simhash import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = WORD.findall((text or "").lower())
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def near_copies(rnd, n_bases=25):
    words = [f"w{i}" for i in range(900)]
    texts = [None, "", "one two", "One  TWO"]
    for _ in range(n_bases):
        base = [rnd.choice(words) for _ in range(rnd.choice([20, 60, 200, 900]))]
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for _ in range(rnd.randrange(1, max(2, len(base) // 40))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(copy))
                copy[at:at] = [rnd.choice(words) for _ in range(len(copy) // 12)]
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_cover_a_similarity(spark):
    texts = near_copies(random.Random(21))
    prints, sets = [slow_fingerprint(t, 5) for t in texts], [shingles(t) for t in texts]
    far = lambda a, b: (prints[a] ^ prints[b]).bit_count() > 3
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    similar = [(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8]
    assert sum(far(a, b) for a, b in similar) > 15
    roots = union_find(len(texts), similar + [(a, b) for a, b in pairs if not far(a, b)])
    rows = near_duplicates(frame(spark, texts), width=5, similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(roots))


def test_stage_removes_near_copies(spark):
    texts = near_copies(random.Random(22), 8)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    left = [shingles(r.text) for r in pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert not [1 for i, a in enumerate(left) for b in left[:i] if jaccard(a, b) >= 0.8]


def test_stage_tells_documents_apart_by_id_and_text(spark):
    rnd = random.Random(23)
    texts = [" ".join(f"w{rnd.randrange(900)}" for _ in range(60)) for _ in range(8)]
    rows = [
        (5, texts[0]), (None, texts[0]),  # a copy under a null id goes ...
        (None, texts[1]), (None, texts[2]),  # ... and other null ids stay
        (7, texts[0]), (7, texts[3]),  # one text of an id goes, the other stays
        (8, texts[4]), (8, texts[5]),  # two texts under one id stay
        (None, texts[6]), (None, texts[6]), (None, texts[6].replace(" ", "  ", 1)),  # a group of null ids keeps one
        (9, texts[7]), (9, texts[7]),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), " ".join(r.text.split())) for r in pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert got == sorted([("5", texts[0]), ("None", texts[1]), ("None", texts[2]), ("7", texts[3]), ("8", texts[4]), ("8", texts[5]), ("None", texts[6]), ("9", texts[7])])


@pytest.mark.parametrize("hot", [0, 330])
def test_sharding_keeps_every_group_that_fits_together(spark, hot):
    texts = ["hot"] * hot + [f"pair {i // 2}" for i in range(560)] + [f"seven {i // 7}" for i in range(140)]
    docs = frame(spark, texts)
    rows = shard_documents(docs).collect()
    shards, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
        sizes[r.shard] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    # without other rows to fill up with, a pair may be left over in a shard of odd quota
    assert sum(len(s) > 1 for t, s in shards.items() if t != "hot") <= (0 if hot else 8)


def test_sharding_keeps_copies_of_one_cell_together(spark):
    # every row has the same id, so each group lies in a single cell
    texts = [f"pair {i // 2}" for i in range(400)] + [f"single {i}" for i in range(200)]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    shards = defaultdict(set)
    for r in shard_documents(docs).collect():
        shards[r.text_crc32].add(r.shard)
    assert all(len(shards[zlib.crc32(f"pair {i}".encode())]) == 1 for i in range(200))


def test_short_lines_take_part_in_line_dedup(spark, tmp_path):
    link = "a line of 26 characters ok"
    texts = ["Read more\n}\n \n\n" + link, " \n\nRead more\nother\n}", "Read  more\n" + link.replace("26", "27"), "other"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_checked, r.dropped) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert rows == {0: (3, []), 1: (3, [2, 4]), 2: (2, [1]), 3: (1, [0])}
    left = {r.doc_id: r.text for r in pipeline.line_stage(spark, docs, "").collect()}
    assert left == {0: texts[0], 1: " \n\nother", 2: "Read  more"}


def test_frequent_passages_and_hubs_lose_no_link(spark, monkeypatch):
    """Texts that share a passage, and copies around one original, with all rounds that put off or spare pairs forced on."""
    rnd = random.Random(24)
    words = [f"w{i}" for i in range(4000)]
    draw = lambda n: [rnd.choice(words) for _ in range(n)]
    passage, original = draw(40), draw(150)
    texts = [" ".join(draw(60) + passage + draw(60)) for _ in range(40)]
    texts += [" ".join(passage + draw(8)) for _ in range(10)]
    for _ in range(40):
        copy = list(original)
        for _ in range(rnd.randrange(1, 7)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    texts.append(" ".join(original))
    prints, sets = [slow_fingerprint(t, 5) for t in texts], [shingles(t) for t in texts]
    roots = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8])
    for settings in ({}, {"_PAIRS_A_ROW": 0, "_PAIRS_A_ROW_AFTER": 0, "_HOT": 2}, {"_PAIRS_A_ROW": 0, "_HOT": 3}, {"_PAIRS_A_ROW_AFTER": 0}):
        with monkeypatch.context() as m:
            for k, v in settings.items():
                m.setattr(simhash, k, v)
            rows = near_duplicates(frame(spark, texts), width=5, similarity=0.8).collect()
        assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(roots)), settings
