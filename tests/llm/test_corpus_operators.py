"""Operators that compare documents: near-duplicates, line dedup, perplexity, classifier, sharding, chat formatting."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from siftlake.llm import chat_format, line_dedup, perplexity, registry
from siftlake.llm.components import components
from siftlake.llm.line_dedup import banded_distance, dedup_lines, dedup_report, edit_links
from siftlake.llm.perplexity import ORDER, build_model, count_grams, quality_rules, ship_model
from siftlake.llm.quality_qda import FEATURES, QuadraticDiscriminant, quality_scores, statistics
from siftlake.llm.sharding import shard_documents
from siftlake.llm.simhash import _flips, fingerprint, links, near_duplicates

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, **more):
    """Documents numbered from 0, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", "y", 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, dropped string, line string, score double")


def union_find(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ---------------------------------------------------------------- near-duplicates


def slow_fingerprint(text, width=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_half_near_a_fingerprint_has_its_home_among_the_replicas():
    rnd = random.Random(1)

    def syndrome(x):
        s = 0
        for p in range(31):
            if x >> p & 1:
                s ^= p + 1
        return s

    for _ in range(300):
        x = rnd.getrandbits(32)
        for change in [0, *(1 << p for p in range(32))]:
            y = x ^ change
            home = syndrome(y)
            anchor = y ^ (1 << home - 1 if home else 0)
            assert anchor in {x ^ f for f in _flips(syndrome(x))}
    assert max(len(_flips(s)) for s in range(32)) == 17


def test_links_lose_nothing(spark):
    rnd = random.Random(2)
    prints = set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(10):
            x = base
            for b in rnd.sample(range(64), rnd.randrange(5)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(prints)]
    got = [(r.u, r.v) for r in links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    n = 120
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(70)] + [(0, i) for i in range(60, 80)] + [(i, i + 1) for i in range(90, 118)]
    roots = union_find(n, pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: roots[x] for p in pairs for x in p if p[0] != p[1]}


def test_near_duplicates(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "One", "two words", "A b\tC", "a B c"]
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 400, 1500]))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    prints = [slow_fingerprint(t) for t in texts]
    roots = union_find(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    docs = frame(spark, texts)
    rows = near_duplicates(docs.union(docs.limit(2))).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert (int(r.fingerprint, 16), len(r.fingerprint), r.component_id) == (prints[r.doc_id], 16, roots[r.doc_id])
    assert near_duplicates(docs.limit(0)).collect() == []


def test_fingerprint_of_a_long_text():
    text = " ".join(str(i % 97) for i in range(70_000))
    assert int.from_bytes(fingerprint(text.encode()), "big") == slow_fingerprint(text)


# ---------------------------------------------------------------- line dedup


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rnd, s, most):
    s = list(s)
    for _ in range(rnd.randrange(most + 1)):
        if not s:
            break
        i, kind = rnd.randrange(len(s)), rnd.randrange(3)
        if kind == 0:
            s.insert(i, rnd.choice("abé"))
        elif kind == 1:
            del s[i]
        else:
            s[i] = rnd.choice("aé🎉")
    return "".join(s)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edit_links_against_brute_force(spark, threshold):
    rnd = random.Random(threshold)
    bases = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(40, 60))) for _ in range(20)]
    lines = sorted({m for b in bases for m in [b, *(changed(rnd, b, 4) for _ in range(8))] if len(m) >= 40})
    df = spark.createDataFrame([(i, (len(s) << 32) + i, s, len(s)) for i, s in enumerate(lines)], "h1 long, h2 long, line string, n_chars int")
    got = {(r.a.h1, r.b.h1): r.distance for r in edit_links(df.union(df.limit(5)), threshold).collect()}
    want = {(i, j): d for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= threshold and (d := edit_distance(lines[i], lines[j])) <= threshold}
    assert got == want


@pytest.mark.parametrize("hot_pairs", [0, 8])
def test_lines_that_share_a_segment_keep_all_links(spark, monkeypatch, hot_pairs):
    rnd = random.Random(31)
    heads = ["all of these lines start alike, é " * 2, "short head "]
    lines = set()
    for h in heads:
        for _ in range(25):
            tail = "".join(rnd.choice("abc01") for _ in range(rnd.randrange(6, 14)))
            lines |= {h + tail, changed(rnd, h + tail, 3), changed(rnd, h, 2) + tail}
    lines = sorted(x for x in lines if len(x) >= 10)
    df = spark.createDataFrame([(i, (len(s) << 32) + i, s, len(s)) for i, s in enumerate(lines)], "h1 long, h2 long, line string, n_chars int")
    monkeypatch.setattr(line_dedup, "_HOT_PAIRS", hot_pairs)
    got = {(r.a.h1, r.b.h1): r.distance for r in edit_links(df).collect()}
    assert got == {(i, j): d for j in range(len(lines)) for i in range(j) if abs(len(lines[i]) - len(lines[j])) <= 2 and (d := edit_distance(lines[i], lines[j])) <= 2}


def test_twenty_thousand_lines_that_share_a_segment(spark):
    rnd = random.Random(32)
    lines = list({"this line is the same in all of them " + "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(20_000)})
    near = [(i, x[:-3] + "!" + x[-2:]) for i, x in enumerate(lines[:20])]
    rows = [(i, (len(s) << 32) + i, s, len(s)) for i, s in enumerate([*lines, *(x for _, x in near)])]
    links = edit_links(spark.createDataFrame(rows, "h1 long, h2 long, line string, n_chars int"))
    assert {(r.a.h1, r.b.h1) for r in links.collect()} == {(i, len(lines) + k) for k, (i, _) in enumerate(near)}


@pytest.mark.parametrize("threshold", [1, 2, 4])
def test_banded_distance(spark, threshold):
    rnd, pairs = random.Random(threshold), []
    while len(pairs) < 800:
        a = "".join(rnd.choice("abé🎉") for _ in range(rnd.randrange(threshold, threshold + 14)))
        b = changed(rnd, a, threshold + 2) if a else a
        if abs(len(a) - len(b)) <= threshold <= max(len(a), len(b)):
            pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", banded_distance(F.col("a"), F.col("b"), threshold).alias("d")).collect():
        assert min(r.d, threshold + 1) == min(edit_distance(r.a, r.b), threshold + 1), r


def brute_lines(texts, min_chars=40, threshold=2, short_lines=False):
    """Dropped positions of each document, and links of its lines."""
    first = {}
    takes_part = lambda x: len(x) >= min_chars or short_lines and WORD.search(x)
    for i, t in enumerate(texts):
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if takes_part(line):
                first.setdefault(line, (i, p))
    long = [x for x in first if len(x) >= min_chars]
    linked = {a: [b for b in long if len(a) >= min_chars and a != b and edit_distance(a, b) <= threshold] for a in first}
    dropped, n_links = [], []
    for i, t in enumerate(texts):
        lines = [(p, x) for p, x in enumerate(t.split("\n") if t is not None else []) if takes_part(x)]
        dropped.append([p for p, x in lines if first[x] != (i, p) or any(first[b] < first[x] for b in linked[x])])
        n_links.append(sum(len(linked[x]) for _, x in lines))
    return dropped, n_links


def test_line_dedup(spark):
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcd é") for _ in range(rnd.randrange(38, 50))) for _ in range(12)]
    texts = [None, "", "\n", "short\nshort", pool[0], pool[0], "\n".join([pool[1], "", pool[1], "tail"])]
    for _ in range(25):
        texts.append("\n".join(changed(rnd, rnd.choice(pool), 3) for _ in range(rnd.randrange(1, 5))))
    texts.append("\n".join([pool[2]] * 200 + ["x" * 50_000]))
    docs = frame(spark, texts)
    dropped, n_links = brute_lines(texts)
    rows = {r.doc_id: r for r in dedup_report(docs).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].dropped, rows[i].n_links, rows[i].n_dropped) == (dropped[i], n_links[i], len(dropped[i])), i
        assert rows[i].n_lines == (0 if t is None else t.count("\n") + 1)
    cut = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert len(cut) == len(texts) and cut[0].asDict().keys() == docs.first().asDict().keys()
    for i, t in enumerate(texts):
        assert cut[i].text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in dropped[i]))
    assert dedup_report(docs.limit(0)).collect() == dedup_lines(docs.limit(0)).collect() == []


def test_line_dedup_of_repeated_and_null_ids(spark):
    line = "a line that is long enough to take part here"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + "\nb"), (None, line), (2, "other\n" + line)], "doc_id long, text string")
    rows = sorted((r.doc_id is not None, r.doc_id or 0, r.n_lines, r.dropped) for r in dedup_report(docs).collect())
    assert rows == [(False, 0, 1, []), (True, 1, 1, [0]), (True, 1, 1, [0]), (True, 2, 2, [0]), (True, 2, 2, [1])]


def test_line_dedup_plan_has_no_python(spark):
    docs = frame(spark, ["x" * 50])
    for df in (dedup_report(docs), dedup_lines(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


# ---------------------------------------------------------------- perplexity


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def grams_of(text):
    words = WORD.findall(text or "")
    s = " " * (ORDER - 1) + " ".join(words) + " "
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)] if words else []


def brute_kneser_ney(texts, shared_only=True):
    """Probabilities of n-grams of all orders and weights of backing off, straight from the definition; those that one text alone has (with its copies) go at the end."""
    counts, owners = {ORDER: Counter()}, {ORDER: defaultdict(set)}
    for t in texts:
        counts[ORDER].update(own := grams_of(t))
        for g in own:
            owners[ORDER][g].add(tuple(own))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        owners[k] = defaultdict(set)
        for g, who in owners[k + 1].items():
            owners[k][g[1:]] |= who
    p, back, alone = {"": 1 / (len(counts[1]) + 1)}, {}, defaultdict(set)
    for k in range(1, ORDER + 1):
        n = [sum(c == j for c in counts[k].values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0.0] + [max(0.01, min(float(j), j - (j + 1) * y * n[j + 1] / n[j])) if y is not None and n[j] else j / 2 for j in (1, 2, 3)]
        followers, context_owners = defaultdict(list), defaultdict(set)
        for g, c in counts[k].items():
            followers[g[:-1]].append(c)
            context_owners[g[:-1]] |= owners[k][g]
        for g, c in counts[k].items():
            own = followers[g[:-1]]
            back[g[:-1]] = gamma = sum(d[min(x, 3)] for x in own) / sum(own)
            p[g] = (c - d[min(c, 3)]) / sum(own) + gamma * p[g[1:]]
            if len(owners[k][g]) < 2:
                alone["p"].add(g)
            if len(context_owners[g[:-1]]) < 2:
                alone["back"].add(g[:-1])
    if shared_only:
        p, back = {g: x for g, x in p.items() if g not in alone["p"]}, {g: x for g, x in back.items() if g not in alone["back"]}
    return p, back


def backed_off(p, back, gram):
    return p[gram] if gram in p else back.get(gram[:-1], 1) * backed_off(p, back, gram[1:])


TEXTS = [
    None, "", " \t\n", "a b c d e f g h i", "a b c d e f g h i j", "the cat sat on the mat and the dog sat on the log while it was raining out there",
    "one two three four five one two three four five six seven eight nine ten eleven", "x\n\nx\ny\n \n \nx # * $ % & | < >", "word " * 3000, "ünï cödé 日本 " * 4 + "fin",
    "the cat sat on the log and the dog sat on the mat while it was raining out here", "one two three four five six seven eight nine ten eleven twelve", "ünï cödé 日本 again",
]


def test_base_rules_and_bands(spark):
    docs = frame(spark, TEXTS)
    rows = {r.doc_id: r for r in quality_rules(docs, keep=("doc_id", "fp", "line")).collect()}
    for i, t in enumerate(TEXTS):
        base = brute_base(t)
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r.kept == (not r.base_failed and r.low <= r.mean_nll <= r.high)


def test_scoring_by_blocks_agrees(spark):
    docs = frame(spark, TEXTS).union(frame(spark, TEXTS[4:7]))
    docs = docs.unionByName(docs.limit(6).withColumn("lang", docs["source"].substr(5, 1)))
    one, many = ([tuple(r) for r in quality_rules(docs, block_bytes=b).collect()] for b in (1 << 20, 6000))
    assert sorted(map(repr, one)) == sorted(map(repr, many))


def test_model_is_dealt_into_blocks(spark):
    model = build_model(count_grams(frame(spark, TEXTS).select("lang", "text")))
    whole, blocks = ship_model(model), ship_model(model, 6000)
    assert len(whole.parts) == 1 and len(blocks.parts) > 2
    entries = [b.value["en"] for b in blocks.parts]
    assert set(np.concatenate(entries)["hash"]) == set(whole.parts[0].value["en"]["hash"]) and max(x.nbytes for x in entries) < whole.parts[0].value["en"].nbytes


@pytest.mark.parametrize("shared_only", [True, False])
def test_model_is_kneser_ney(spark, shared_only):
    texts = [*TEXTS, TEXTS[5], TEXTS[9]]
    want, back = brute_kneser_ney(texts, shared_only)
    model = build_model(count_grams(frame(spark, texts).select("lang", "text")), shared_only=shared_only)
    got = {r.gram: r.logp for r in model.filter("logp is not null").collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for g, p in want.items():
        assert abs(got[g] / 2**20 - np.log(p)) < 2e-6
    weights = {r.gram: r.back for r in model.filter("back is not null").collect()}
    assert weights.keys() == back.keys()
    assert all(abs(w / 2**20 - np.log(back[c])) < 2e-6 for c, w in weights.items())


def test_whole_model_is_a_distribution(spark):
    p, back = brute_kneser_ney(TEXTS, shared_only=False)
    alphabet = {g for g in p if len(g) == 1}
    for context in ("", "a", "the ", "on t", "ne", "    "):
        # one more character stands for all that the corpus lacks
        assert abs(sum(backed_off(p, back, context + c) for c in alphabet) + backed_off(p, back, context + "\0") - 1) < 1e-9


def test_perplexity_is_that_of_the_model(spark):
    p, back = brute_kneser_ney(TEXTS)
    for r in quality_rules(frame(spark, TEXTS)).collect():
        if grams := grams_of(TEXTS[r.doc_id]):
            assert abs(r.mean_nll + sum(np.log(backed_off(p, back, g)) for g in grams) / len(grams)) < 1e-5


def test_counting_in_parts_agrees(spark, monkeypatch):
    """A worker that puts out its n-grams early, and alphabets beyond what is packed, change nothing."""
    monkeypatch.setattr(perplexity, "_HELD", 40)
    monkeypatch.setattr(perplexity, "_CHUNK", 64)
    monkeypatch.setattr(perplexity, "_ROWS", 16)
    monkeypatch.setattr(perplexity, "_BITS", 6)
    cloudpickle.register_pickle_by_value(perplexity)
    try:
        counted = {r.gram: r.c for r in count_grams(frame(spark, TEXTS).select("lang", "text")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(perplexity)
    assert counted == Counter(g for t in TEXTS for g in grams_of(t))


def clean_texts(rnd, n, words=60):
    vocabulary = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 7))) for _ in range(words)]
    return [" ".join(rnd.choice(vocabulary) for _ in range(120)) for _ in range(n)]


def test_noise_leaves_the_band_whatever_its_copies(spark):
    rnd = random.Random(5)
    noise = ["".join(chr(rnd.randrange(33, 126)) + " " * (j % 5 == 0) for j in range(300)) for _ in range(4)]
    texts = clean_texts(rnd, 60) + [x for k, x in enumerate(noise) for _ in range(k + 1)]
    rows = {r.doc_id: r for r in quality_rules(frame(spark, texts)).collect()}
    assert all(rows[i].kept for i in range(60))
    for i in range(60, len(texts)):
        assert not rows[i].kept and not rows[i].base_failed and rows[i].mean_nll > rows[i].high


def test_stock_phrases_leave_the_band_below(spark):
    rnd = random.Random(6)
    stock = "in accordance with the aforementioned provisions hereinafter referred to as regulations concerning documentation".split()
    texts = [f"{t} {' '.join(stock)} {t[::-1][:40]}" for t in clean_texts(rnd, 60, 800)]
    # the phrase again and again, broken off so early and in so many ways that few windows of five words repeat
    below = " ".join(" ".join(stock[i : i + n]) for n in (2, 3, 4) for i in range(len(stock) - n + 1))
    rows = {r.doc_id: r for r in quality_rules(frame(spark, [*texts, below])).collect()}
    assert all(rows[i].kept for i in range(60))
    assert not rows[60].base_failed and rows[60].mean_nll < rows[60].low and not rows[60].kept


def test_quality_rules_without_documents(spark):
    assert quality_rules(frame(spark, ["x"]).limit(0)).collect() == []
    assert [r.kept for r in quality_rules(frame(spark, [None, ""])).collect()] == [False, False]


# ---------------------------------------------------------------- classifier


def test_discriminant_is_that_of_two_gaussians():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))))
    y = np.repeat([0, 1], [400, 600])
    model = QuadraticDiscriminant(shrink_pooled=0, shrink_identity=0).fit(np.array([400.0, 600.0]), np.array([x[y == k].sum(0) for k in (0, 1)]), np.array([x[y == k].T @ x[y == k] for k in (0, 1)]))
    log = []
    for k in (0, 1):
        m, c = x[y == k].mean(0), np.cov(x[y == k].T)
        log.append(np.log((y == k).sum() + 1) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_calibration_fits_the_labels():
    rng = np.random.default_rng(1)
    margins = np.arange(-100, 101) * 0.5
    truth = 1 / (1 + np.exp(-(0.3 * margins - 1)))
    total = rng.integers(200, 400, len(margins))
    ones = rng.binomial(total, truth)
    model = QuadraticDiscriminant()
    model._means = [np.zeros(1)]
    slope, offset = model.calibrate(margins, np.stack([total - ones, ones], axis=1).astype(float)).line
    assert abs(slope - 0.3) < 0.02 and abs(offset + 1) < 0.1
    for counts in (np.zeros((201, 2)), np.eye(201, 2), np.stack([total, 0 * total], axis=1)):
        assert QuadraticDiscriminant().calibrate(margins, counts).line == (1.0, 0.0)
    model = QuadraticDiscriminant()
    model._means = [np.zeros(1)]
    # labels that the margins part, and margins that mislead
    assert 0 < model.calibrate(margins, np.stack([margins < 0, margins >= 0], axis=1).astype(float)).line[0] < 100
    assert model.calibrate(margins, np.stack([margins > 0, margins <= 0], axis=1).astype(float)).line[0] > 0


def test_statistics_of_odd_texts():
    for t in (None, b"", b" \n ", b"a", "ü\n\n".encode() * 1000, b"x" * 200_000):
        values = statistics(t)
        assert len(values) == len(FEATURES) and np.isfinite(values).all()


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in registry.table(spark, sf, "labels").collect()}
    rows = registry.op4_quality_qda(spark, sf).collect()
    assert len(rows) == registry.table(spark, sf, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97


def test_scores_are_calibrated(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in registry.table(spark, sf, "labels").collect()}
    held = [(r.score, labels[r.doc_id]) for r in registry.op4_quality_qda(spark, sf).collect() if r.held_out and r.doc_id in labels]
    p, y = (np.array(x) for x in zip(*held, strict=True))
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) < 0.1 and abs(p.mean() - y.mean()) < 0.02


def test_quality_with_odd_labels(spark):
    docs = frame(spark, [None, "", "some text", "more text"])
    odd = spark.createDataFrame([(0, None, 1), (1, 1, 0), (1, 1, 0), (None, 0, 1), (2, 7, 0)], "doc_id long, quality int, score int")
    rows = quality_scores(docs.union(docs.limit(1)), odd).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1
    assert quality_scores(docs.limit(0), odd).collect() == []
    assert {r.score for r in quality_scores(docs, odd.limit(0)).collect()} == {0.5}


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, shards):
    rnd = random.Random(6)
    texts = [None, "", *["hot"] * 150, *(f"group {i % 40}" for i in range(120)), *(f"single {i}" for i in range(160)), "ü" * 10_000]
    rnd.shuffle(texts)
    docs = frame(spark, texts)
    rows = shard_documents(docs, shards=shards).collect()
    by_shard, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        by_shard[r.shard].append(r.slot)
        groups[texts[r.doc_id] or ""].add(r.shard)
    assert len(rows) == len(texts) and set(by_shard) == set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert sum(len(s) > 1 for g, s in groups.items() if g != "hot") <= 1
    again = sorted(map(tuple, shard_documents(docs.orderBy("text"), shards=shards).select("doc_id", "shard", "slot").collect()))
    assert again == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_sharding_few_rows(spark):
    docs = frame(spark, ["a", "b", "a"])
    assert shard_documents(docs.limit(0)).collect() == []
    assert sorted(r.slot for r in shard_documents(docs.union(docs)).collect()) == [0] * 6


# ---------------------------------------------------------------- chat formatting


def turns(rnd, n):
    word = lambda most: "".join(rnd.choice("\\#<:>\n hlcn/turn ab") for _ in range(rnd.randrange(most)))
    return [(rnd.choice(["user", "assistant", word(6)]), word(12)) for _ in range(n)]


def test_template_is_reversible_and_spans_are_right():
    rnd, template = random.Random(7), chat_format.MarkedTurns()
    for _ in range(500):
        given = turns(rnd, rnd.randrange(5))
        text, spans, rewritten = chat_format.locate(template, given)
        assert template.parse(text) == given and rewritten is None
        assert [template.unescape(text[s[2] : s[3]]) for s in spans] == [t for _, t in given]


def test_long_conversations_agree_with_all_prefixes():
    template = chat_format.MarkedTurns()
    given = turns(random.Random(8), 400)
    assert chat_format._by_windows(template, given) == chat_format._by_prefixes(template, given)[:2]


class Forgets:
    def render(self, given):
        return "".join(f"<{r}>{t if i >= len(given) - 2 else 'old'}</>" for i, (r, t) in enumerate(given))


class Renames:
    def render(self, given):
        return ("LONG " if len(given) >= 150 else "") + chat_format.MarkedTurns().render(given)


def test_templates_that_rewrite_history_are_detected():
    given = turns(random.Random(9), 300)
    assert chat_format.locate(Forgets(), given[:6])[2] == 2
    assert chat_format.locate(Forgets(), given)[2] == 2
    assert chat_format.locate(Renames(), given)[2] == 149


def test_chat_query(spark):
    rows = registry.table(spark, SF, "conversations").collect()
    by_conv = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.turn):
        by_conv[r.conv_id].append((r.role, r.text))
    hostile = "\\### Assistant: </turn> ok"
    by_conv[-7] = [("user", hostile), ("assistant", hostile)]
    got = {r.conv_id: r for r in registry.op6_chat_format(spark, SF).collect()}
    assert got.keys() == by_conv.keys()
    for conv, given in by_conv.items():
        loss = "".join(t for r, t in given if r == "assistant")
        assert got[conv].n_turns == len(given) and got[conv].rewritten_turn is None
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in given).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(registry.oracle_sql()["op6_chat_format"])
    rows = registry.op6_chat_format(spark, SF).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


def test_chat_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, None, "assistant", "n", "x"), (1, None, "first", "", "x")], "conv_id long, turn long, role string, text string, formatted string")
    template = chat_format.MarkedTurns()
    got = {r.conv_id: template.parse(r.formatted) for r in chat_format.format_conversations(rows, template).collect()}
    assert got == {1: [("first", ""), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "n")]}
    assert chat_format.format_conversations(rows.limit(0), template).collect() == []
    assert {r.rewritten_turn for r in chat_format.format_conversations(rows.filter("turn = 0"), Forgets()).collect()} == {2}
