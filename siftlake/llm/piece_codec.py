"""Encoding and decoding with merge-type (BPE) piece vocabularies.

A segment is a run of spaces with the word that follows.  No piece of a fitting
vocabulary holds a space mark after another character (checked at load), so no
merge crosses a segment's start and segments encode independently.  Within a
segment, a score-ordered agenda of adjacent symbol pairs drives the merges:
the best-scored pair is taken first, the leftmost among equals; pairs whose
symbols have changed since are skipped.  Characters that no piece covers fall
back to byte pieces.

Every distinct segment a worker meets is checked against the sentencepiece
library, encoding and decoding, in the Arrow batch in which it first occurs.
Texts are decoded from all of their ids.
"""

from __future__ import annotations

import hashlib
import heapq
import operator
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, Cache, on_workers, read_bytes, resident, ship, slim, text_slices, trim, with_text

_MARK = "▁"
_MARK_UTF8 = _MARK.encode()
_SEGMENT = re.compile(rb" +[^ ]*")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Symbols up to which the agenda of a segment is a list, and what stands there for a pair that is no piece.
_SHORT, _NO_PLACE = 64, 1 << 60
#: Segments that the library gets as one text.
_TOGETHER = 64


def _repaired(run: bytes) -> bytes:
    """UTF-8 with a replacement character for each byte that is part of no character."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(run):
        lead = run[i]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            run[i : i + n].decode()
            out.append(run[i : i + n])
            i += n
        except UnicodeDecodeError:
            out.append("\ufffd".encode())
            i += 1
    return b"".join(out)


class PieceCodec:
    def __init__(self, model: bytes, cache_bytes: int = CACHE_BYTES):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or trainer.treat_whitespace_as_suffix or not trainer.byte_fallback:
            raise ValueError("a BPE vocabulary with byte fallback and space prefixes is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if {p.type for p in proto.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        if any(_MARK in p.piece.lstrip(_MARK) for p in proto.pieces if p.type == _NORMAL):
            raise ValueError("a piece holds a space after another character")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == _NORMAL}
        # places of the scores, best first; equal scores have one place
        places = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        self._place = {piece: places[x] for piece, x in self.score.items()}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == _BYTE:
                self.byte_id[int(p.piece[1:-1], 16)] = i
                self.byte_of[i] = int(p.piece[1:-1], 16)
        # what a piece decodes to, but for the space of a first one
        plain = {_NORMAL: lambda i: self.pieces[i].replace(_MARK, " ").encode(), _UNKNOWN: lambda i: " ⁇ ".encode(), _CONTROL: lambda i: b"", _BYTE: lambda i: bytes([self.byte_of[i]])}
        self._bytes = [plain[k](i) for i, k in enumerate(self.kinds)]
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self._cache: Cache[bytes] = Cache(cache_bytes)

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of one segment, whose spaces are already marks."""
        symbols = list(segment)
        symbols = self._merged(symbols) if len(symbols) <= _SHORT else self._merged_long(symbols)
        ids = list(map(self.id_of.get, symbols))
        if None not in ids:
            return ids
        return [x for i, s in zip(ids, symbols, strict=True) for x in ([i] if i is not None else map(self.byte_id.__getitem__, s.encode()))]

    def _merged(self, symbol: list[str]) -> list[str]:
        """The agenda as a list with the place of each symbol's pair with the next one: of few pairs the best is found faster than a heap is kept."""
        place, none = self._place.get, _NO_PLACE
        agenda = [place(p, none) for p in map(operator.add, symbol, symbol[1:])]
        while agenda:
            best = min(agenda)
            if best == none:
                break
            i = agenda.index(best)
            pair = symbol[i] + symbol[i + 1]
            symbol[i : i + 2] = (pair,)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = place(pair + symbol[i + 1], none)
            if i:
                agenda[i - 1] = place(symbol[i - 1] + pair, none)
        return symbol

    def _merged_long(self, symbol: list[str | None]) -> list[str]:
        """The same with a heap, whose entries are place and index of the left symbol; one holds while the symbol there and the next one make a pair of that place."""
        place = self._place.get
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(p, i) for i, p in enumerate(map(place, map(operator.add, symbol, symbol[1:]))) if p is not None]
        heapq.heapify(agenda)
        while agenda:
            best, i = heapq.heappop(agenda)
            j, left = after[i], symbol[i]
            if left is None or j == n:
                continue
            pair = left + symbol[j]
            if place(pair) != best:
                continue
            symbol[i], symbol[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = place(pair + symbol[k])
                if p is not None:
                    heapq.heappush(agenda, (p, i))
            h = before[i]
            if h >= 0:
                p = place(symbol[h] + pair)
                if p is not None:
                    heapq.heappush(agenda, (p, h))
        return list(filter(None, symbol))

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control pieces vanish, byte pieces become characters, the space of a first ordinary piece goes."""
        return self.decode_bytes(ids).decode()

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The same as UTF-8."""
        text = b"".join(map(self._bytes.__getitem__, ids))
        try:
            text.decode()
        except UnicodeDecodeError:  # byte pieces that make no characters
            text = self._decode(ids)
        first = next((i for i in ids if self.kinds[i] != _CONTROL), None)
        return text[1:] if first is not None and self.kinds[first] == _NORMAL and self.pieces[first].startswith(_MARK) else text

    def _decode(self, ids: list[int]) -> bytes:
        out: list[bytes] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_repaired(bytes(run)))
                run = bytearray()
            out.append(self._bytes[i])
        out.append(_repaired(bytes(run)))
        return b"".join(out)

    def _learn(self, keys: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new segments, given without their first space; each is decoded too, and must come back as it was."""
        strings = [k.decode() for k in keys]
        coded = [self.encode_segment(_MARK + s.replace(" ", _MARK)) for s in strings]
        plain = self._bytes.__getitem__
        for k, ids in zip(keys, coded, strict=True):
            # bytes that make up a whole segment make characters, so none would be replaced
            if b"".join(map(plain, ids)) != b" " + k:
                raise AssertionError(f"segment {k!r} decodes to {self._decode(ids)!r}")
        # a segment that ends with a space would run into the one behind it; the library returns nothing for an empty text
        apart = [i for i, s in enumerate(strings) if s and s[-1] == " "]
        together = [i for i, s in enumerate(strings) if s and s[-1] != " "]
        groups = [*([i] for i in apart), *(together[i : i + _TOGETHER] for i in range(0, len(together), _TOGETHER))]
        asked = [" ".join(map(strings.__getitem__, g)) for g in groups]
        truth = self.library.encode(asked, num_threads=1)
        said = self.library.decode(truth, num_threads=1)
        for g, text, ids, back in zip(groups, asked, truth, said, strict=True):
            if ids != list(chain.from_iterable(map(coded.__getitem__, g))) or back != text:
                raise AssertionError(f"segments {text!r} differ from the library: {[coded[i] for i in g]} and {ids}")
        ends = list(accumulate(map(len, coded), initial=0))
        data = np.array(list(chain.from_iterable(coded)), dtype="<u4").tobytes()
        return {k: data[4 * a : 4 * b] for k, (a, b) in zip(keys, pairwise(ends), strict=True)}

    def forget(self) -> None:
        self._cache.clear()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (little-endian unsigned 32-bit, with begin and end)."""
        parts: list[list[bytes]] = []
        wanted: set[bytes] = set()
        for t in texts:
            if not t:
                parts.append([])
                continue
            if _MARK_UTF8 in t:
                t = t.replace(_MARK_UTF8, b" ")
            if b"  " in t or t[:1] == b" " or t[-1:] == b" ":
                p = [s[1:] for s in _SEGMENT.findall(b" " + t)]
            else:
                p = t.split(b" ")
            parts.append(p)
            wanted.update(p)
        ids_of = self._cache.serve(wanted, self._learn).__getitem__
        begin, end = (np.array([x], dtype="<u4").tobytes() for x in (self.bos, self.eos))
        return [begin + b"".join(map(ids_of, p)) + end for p in parts]

    def run(self, texts: list[bytes | None]) -> list[tuple[bytes, bytes]]:
        """Ids of each text, and what all of its ids together decode to."""
        return [(ids, self.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())) for ids in self.encode(texts)]

    def check_texts(self, texts: list[bytes | None], results: list[tuple[bytes, bytes]]) -> None:
        """Hold whole texts against the library."""
        plain = [t.decode() if t else "" for t in texts]
        for ids, (own, back) in zip(self.library.encode(plain, add_bos=True, add_eos=True, num_threads=1), results, strict=True):
            if ids != np.frombuffer(own, dtype="<u4").tolist() or self.library.decode(ids) != back.decode():
                raise AssertionError("a text differs from the library")


def encode_decode(docs: DataFrame, model_path: str, *, text_column: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids", "decoded"), check: str = "segments") -> DataFrame:
    """Encode and decode the text of every row of ``docs``.

    ``keep`` columns come first; ``outputs`` may name ``ids`` (array of int, with
    begin and end ids), ``decoded`` (string), ``n_tokens``, ``ids_sha256`` and
    ``decoded_sha256``.  A null text counts as empty: begin and end ids only.
    Rows that repeat are treated alike; columns not in ``keep`` are not read.
    ``check`` is ``segments`` or ``texts``: what is held against the library.
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    slim(docs.sparkSession)  # a worker's model, cache and slice of texts take some 200 MB more than an idle one
    model = read_bytes(model_path)
    shipped = ship(docs.sparkSession, model, len(model))
    made = {
        "ids": lambda ids, text: np.frombuffer(ids, dtype="<u4").astype(np.int32),
        "decoded": lambda ids, text: text.decode(),
        "n_tokens": lambda ids, text: len(ids) // 4,
        "ids_sha256": lambda ids, text: hashlib.sha256(ids).hexdigest(),
        "decoded_sha256": lambda ids, text: hashlib.sha256(text).hexdigest(),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        codec = resident((PieceCodec, hash(model)), lambda: PieceCodec(model))
        for batch in batches:
            for a, b, texts in text_slices(batch.column(at)):
                done = codec.run(texts)
                if check == "texts":
                    codec.check_texts(texts, done)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                columns += [pa.array([made[o](*d) for d in done], kinds[o][1]) for o in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), *outputs])
        trim()

    handed, at = with_text(keep, text_column)
    schema = ", ".join([*(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)), *(f"{o} {kinds[o][0]}" for o in outputs)])
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(handed)))
    return on_workers(rows).mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), *outputs)
