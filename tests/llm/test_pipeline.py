"""The corpus pipeline against a plain composition of brute-force stages."""

import hashlib
import importlib
import math
import random

import public_tokenizers
import pytest
import sentencepiece
from test_corpus_operators import WORD, backed_off, brute_base, brute_kneser_ney, brute_lines, grams_of, slow_fingerprint, union_find
from test_text_operators import brute_hits, folded
from test_whole_job import jaccard, shingles

import corpus_pipeline
from siftlake.llm import pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_corpus():
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8))) for _ in range(150)]
    sentence = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", sentence(14)) for k in range(4)] + [("short", "zu zu zo")]
    texts = [None, "", "too short", " \n\t"]
    for i in range(40):
        texts.append("\n".join(sentence(rnd.randrange(9, 16)) for _ in range(rnd.randrange(2, 6))))
        if i % 8 == 0:
            texts.append(texts[-1])  # an exact copy
        if i % 8 == 3:
            lines = texts[-1].split("\n")
            texts.append("\n".join([lines[0][:-1] + "q", sentence(12), *lines[1:]]))  # a line with one letter changed
        if i % 10 == 5:
            texts.append(f"{sentence(30)}. {items[i % 4][1].upper()}! {sentence(20)}")  # a benchmark passage
    texts.append(items[0][1] + " end")
    texts.append("zu zu zo " + sentence(20))
    texts.append(" ".join(["again and again and more"] * 30))
    texts.append("".join(chr(rnd.randrange(200, 5000)) + " " * (j % 4 == 0) for j in range(400)))
    rows = [(i, t, "fr" if i % 5 == 4 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return rows, items


def expected(rows, items):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    docs = []
    for own in by_lang.values():
        p, back = brute_kneser_ney([r[1] for r in own])
        cost, ok = {}, []
        for r in own:
            base = brute_base(r[1])
            if base[0] >= 10 and 100 * base[4] <= 20 * base[0]:
                grams = grams_of(r[1])
                cost[r[0]] = -sum(math.log(backed_off(p, back, g)) for g in grams) / len(grams)
                ok.append(r)
        bins = sorted(math.floor(c * 100) for c in cost.values())
        q = lambda x: bins[math.ceil(x * len(bins)) - 1] / 100  # noqa: B023, E731
        low, high = q(0.5) - max(0.15, 12 * (q(0.5) - q(0.25))), q(0.5) + max(0.15, 12 * (q(0.75) - q(0.5)))
        slack = lambda r: 4 / math.sqrt(len(grams_of(r[1])))
        docs += [r for r in ok if low - slack(r) <= cost[r[0]] <= high + slack(r)]
    docs.sort()
    dropped, _ = brute_lines([r[1] for r in docs], min_chars=20, short_lines=True)
    left = [(r[0], "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in d), r[2]) for r, d in zip(docs, dropped, strict=True)]
    left = [r for r in left if WORD.search(r[1])]
    prints = [slow_fingerprint(r[1], 5) for r in left]
    sets = [shingles(r[1]) for r in left]
    roots = union_find(len(left), [(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3 or jaccard(sets[a], sets[b]) >= 0.8])
    left = [r for i, r in enumerate(left) if roots[i] == i]
    out = {}
    for doc, text, _ in left:
        n, hit, _ = brute_hits(items, text, 10)
        if 2 * hit <= n:
            out[doc] = (text, hit)
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, items = make_corpus()
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_pipeline(spark, corpus):
    folder, rows, items = corpus
    want = expected(rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert got.keys() == want.keys()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for doc, (text, hit) in want.items():
        r = got[doc]
        if hit:
            assert len(folded(r.text)) == len(folded(text)) - hit and not brute_hits(items, r.text, 10)[1]
        else:
            assert r.text == text
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
        assert r.ids == library.encode(r.text, add_bos=True, add_eos=True) and r.n_chars == len(r.text)
    assert 0 < len(want) < len(rows)


def test_stages_keep_the_columns(spark, corpus):
    folder, _, _ = corpus
    # extra columns with names that the operators use themselves
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS h1", "'x' AS dropped", "2 AS fp", "'y' AS component_id", "3 AS hits")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == list(corpus_pipeline.COLUMNS)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == [*corpus_pipeline.COLUMNS, "n_tokens", "ids", "decoded_sha256"]


def test_stages_on_empty_and_repeated_rows(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    twice = docs.filter("doc_id < 12")
    once = pipeline.near_duplicate_stage(spark, twice, folder)
    both = pipeline.near_duplicate_stage(spark, twice.union(twice), folder)
    assert sorted(r.doc_id for r in both.collect()) == sorted(r.doc_id for r in once.collect())


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
