"""Operators that handle each row by itself: token counts, piece codec, URL filter, decontamination."""

import hashlib
import re

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.llm import registry, url_filter
from siftlake.llm.decontaminate import ItemAutomaton, cut, scan_documents, words_of
from siftlake.llm.piece_codec import PieceCodec, encode_decode
from siftlake.llm.token_counts import RankMerger, token_counts

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "▁x", "x▁", "é́ İ ẞ ß", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>c<|ENDOFTEXT|>",
    "aaaa aaaaaaa don't I'LL we've 'Sfoo", "\x00a\x1cb\x1f c\u2003d\u3000e", "日本語テキスト 🎉🎉 👩\u200d👩\u200d👧", "\n\n a\n", "<0x41> <s></s> <unk>", "a" * 5000, "1234567 ١٢٣ ⅷ½", "ſ K Å", "x " * 3000,
]
CLASH = "id long, k0 long, text_in string, n_tokens long, host string, TEXT_ string"


@pytest.fixture(scope="module")
def merger():
    with open(TOKENIZER, "rb") as f:
        return RankMerger(f.read(), cache_bytes=10_000)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def codec():
    with open(PIECES, "rb") as f:
        return PieceCodec(f.read(), cache_bytes=10_000)


def odd_rows(spark):
    rows = [(i, t, 1, 2, "x", 3, "h", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", 1, 2, "x", 3, "h", "y")], f"doc_id long, text string, {CLASH}")


def test_token_counts_equal_the_library(spark, library):
    got = token_counts(odd_rows(spark), TOKENIZER, limit=100).collect()
    assert len(got) == len(ODD) + 2
    for row in got:
        text = "null id" if row.doc_id is None else ODD[row.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 100)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_token_counts_of_any_text(merger, library, text):
    assert merger.count([text.encode()]) == [len(library.encode(text, add_special_tokens=False).ids)]


def test_token_counts_of_documents(spark, library):
    texts = {r.doc_id: r.text for r in registry.table(spark, SF, "documents").collect()}
    got = {r.doc_id: r.n_tokens for r in registry.op3_token_counts(spark, SF).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_pieces_equal_the_library(spark, codec):
    got = encode_decode(odd_rows(spark), PIECES, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"), check="texts").collect()
    assert len(got) == len(ODD) + 2
    for row in got:
        text = "null id" if row.doc_id is None else ODD[row.doc_id] or ""
        ids = codec.library.encode(text, add_bos=True, add_eos=True)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded == codec.library.decode(ids) == codec.decode(ids)
        assert row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(row.decoded.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(codec, text):
    done = codec.run([text.encode()])
    codec.check_texts([text.encode()], done)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260)), max_size=20))
def test_decoding_any_ids(codec, ids):
    assert codec.decode(ids) == codec.library.decode(ids)


def test_empty_tables(spark):
    none = odd_rows(spark).limit(0)
    assert token_counts(none, TOKENIZER).collect() == []
    assert encode_decode(none, PIECES).collect() == []
    items = spark.createDataFrame([("a", "some words here")], "item_id string, text string")
    assert scan_documents(none, items).collect() == []
    assert {r.n_hit for r in scan_documents(odd_rows(spark), items.limit(0)).collect()} == {0}
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(pages).collect() == []


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "HTTP://A.Example.ORG?x/y#z": ("a.example.org", "", None, "allow"),
        "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "http://example.org/en/1": ("example.org", "/en/1", "example.org/en/1", "block"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://x.com/fr/porn": ("x.com", "/fr/porn", "com/fr/", "allow"),
        "http://x.net/porn": ("x.net", "/porn", None, "block"),
        "http://x.net/pornography": ("x.net", "/pornography", None, "allow"),
        "http://x.net/casino": ("x.net", "/casino", None, "allow"),
        "http://casino.net/casino": ("casino.net", "/casino", None, "allow"),
        "http://casino.net/BET": ("casino.net", "/BET", None, "block"),
        "a://b#c/d": ("b", "", None, "allow"),
    }
    urls = list(cases)
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, id string")
    for r in url_filter.filter_urls(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[urls[r.page_id]], urls[r.page_id]


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_urls_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(registry.oracle_sql()["op5_url_filter"])
    rows = registry.op5_url_filter(spark, sf).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))


def brute_hits(items, text, window):
    words = folded(text or "")
    hit, found = [False] * len(words), set()
    for name, item in items:
        own = folded(item or "")
        size = min(window, len(own))
        for s in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) == s:
                    found.add(name)
                    hit[i : i + size] = [True] * size
    return len(words), sum(hit), sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), min_size=1, max_size=5), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 4))
def test_automaton_against_brute_force(items, doc, window):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    text = " ".join(doc)
    automaton = ItemAutomaton([(n, t.encode()) for n, t in named], window)
    spans, found = automaton.scan([words_of(text.encode())])[0]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert (len(doc), sum(b - a for a, b in spans), sorted(found)) == brute_hits(named, text, window)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    items = [("b", "One two three four five six seven eight nine ten eleven"), ("a", "short item"), ("c", None), ("d", "..."), ("b", "One two three four five six seven eight nine ten eleven"), (None, "null named item")]
    texts = [None, "", "...", "x ONE, two three four five six seven eight nine-ten! eleven y short item", "one two three four five six seven eight nine", "a short\nitem here", "ünë null named item " * 3, "z " * 5000 + "short item"]
    docs = spark.createDataFrame([(i, t, "h", "t") for i, t in enumerate(texts)], "doc_id long, text string, hits string, items string")
    bench = spark.createDataFrame([(n, t, 1) for n, t in items], "item_id string, text string, k0 long")
    for r in scan_documents(docs, bench, block_bytes=block_bytes, with_text=True).collect():
        named = sorted({(n or "", t) for n, t in items if t is not None})
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(named, texts[r.doc_id], 10)
        assert r.over_coverage == (2 * r.n_hit > r.n_words)
        if r.doc_id == 0:
            assert r.clean_text is None
        else:
            assert not brute_hits(named, r.clean_text, 10)[1] or r.doc_id == 6


def test_cut_keeps_what_is_outside():
    assert cut(b"a, b c. d", [(1, 3)]) == b"a, . d"
    assert cut(b"a b", [(0, 2)]) == b""


def test_decontamination_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()["op7_decontaminate"])
    rows = registry.op7_decontaminate(spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
