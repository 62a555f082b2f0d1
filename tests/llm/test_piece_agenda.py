"""What it takes to learn a segment of the piece codec."""

import random

import numpy as np
import public_tokenizers
import pytest

from siftlake.llm.piece_codec import PieceCodec


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return PieceCodec(f.read())


class Counted:
    def __init__(self, library):
        self.library, self.texts = library, 0

    def encode(self, texts, **options):
        self.texts += len(texts)
        return self.library.encode(texts, **options)

    def decode(self, ids, **options):
        return self.library.decode(ids, **options)


def test_library_gets_many_segments_as_one_text_and_none_twice(codec, monkeypatch):
    rng = random.Random(7)
    words = [f"{''.join(rng.choices('aeinorst,.', k=9))}{i}".encode() for i in range(1000)]
    counted = Counted(codec.library)
    monkeypatch.setattr(codec, "library", counted)
    text = b" ".join(words)
    ids = codec.encode([text])
    assert 0 < counted.texts <= 1000 / 32
    asked = counted.texts
    assert codec.encode([text, text]) == ids * 2 and counted.texts == asked
    assert np.frombuffer(ids[0], dtype="<u4").tolist() == counted.library.encode(text.decode(), add_bos=True, add_eos=True)


def test_segments_that_end_with_spaces_are_held_apart(codec):
    texts = [b"a  ", b" ", b"  ", b"one\ntwo   three ", "▁x \U0001d11e\x00".encode(), b"", None]
    codec.check_texts(texts, codec.run(texts))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 400])
def test_both_agendas_merge_alike(codec, n):
    rng = random.Random(n)
    for _ in range(50):
        symbols = ["▁", *rng.choices("aeinorsthé.中\n", k=n)]
        assert codec._merged(list(symbols)) == codec._merged_long(list(symbols))


def test_difference_from_the_library_is_found(codec, monkeypatch):
    encode = codec.encode_segment
    monkeypatch.setattr(codec, "encode_segment", lambda s: [codec.id_of[c] for c in s] if s == "▁the" else encode(s))
    with pytest.raises(AssertionError, match="differ"):
        codec._learn([b"of", b"the", b"and"])
