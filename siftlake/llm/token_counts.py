"""Token counts by rank-synchronous array merging.

All pre-tokens of a batch lie in one ragged numpy array of symbols.  In each
round every sequence looks up the ranks of its adjacent pairs, and applies its
own lowest-ranked merge at all places at once (leftmost first where two places
overlap).  Sequences without a mergeable pair leave the array; what survives is
the number of tokens.

Merging all places at once equals merging them one by one as long as no merge
that uses the new symbol ranks below the merge that made it.  Vocabularies are
checked for that at load; for the few merges that break it (if any) only the
leftmost place is merged in a round.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, Cache, on_workers, read_bytes, resident, ship, text_slices

_NONE = np.int64(1) << 40
_ASCII_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


class RankMerger:
    """Counts tokens of a BPE vocabulary with an end-of-word suffix, given as the JSON of the tokenizers library."""

    def __init__(self, definition: bytes, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE model is needed")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens must match their exact string only")
        library = Tokenizer.from_str(definition.decode())
        self._normalize = library.normalizer.normalize_str if library.normalizer else str
        self._split = library.pre_tokenizer.pre_tokenize_str
        self._special = re.compile("|".join(re.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], dtype=np.int64)
        rank = np.arange(len(merges), dtype=np.int64)
        first_use = np.full(max(self.vocab.values()) + 1, _NONE)
        np.minimum.at(first_use, left, rank)
        np.minimum.at(first_use, right, rank)
        self.one_by_one = first_use[made] <= rank
        key = (left << 32) | right
        order = np.lexsort((rank, key))
        key, rank = key[order], rank[order]
        keep = np.concatenate(([True], key[1:] != key[:-1]))
        self.keys, self.ranks, self.made = key[keep], rank[keep], made
        self._cache: Cache[int] = Cache(cache_bytes)

    def survivors(self, pretokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token once no merge applies."""
        n = np.zeros(len(pretokens), dtype=np.int64)
        vocab, suffix, flat = self.vocab, self.suffix, []
        lengths = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        for p in pretokens:
            if p:
                flat += [vocab[c] for c in p[:-1]]
                flat.append(vocab[p[-1] + suffix])
        symbol, seq = np.array(flat, dtype=np.int64), np.repeat(np.arange(len(pretokens)), lengths)
        while len(symbol):
            key = np.append((symbol[:-1] << 32) | symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            inside = np.append(seq[1:] == seq[:-1], False)
            rank = np.where((self.keys[at] == key) & inside, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(seq)))
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            n[seq[starts[done]]] = sizes[done]
            if done.all():
                break
            best_of = np.repeat(best, sizes)
            chosen = np.flatnonzero((rank == best_of) & (rank != _NONE))
            chosen = self._apart(chosen, rank, seq)
            symbol[chosen] = self.made[rank[chosen]]
            live = ~np.repeat(done, sizes)
            live[chosen + 1] = False
            symbol, seq = symbol[live], seq[live]
        return n

    def _apart(self, chosen: np.ndarray, rank: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Of places that overlap (the pair is twice the same symbol), every second from the left."""
        new_run = np.concatenate(([True], (np.diff(chosen) > 1) | (seq[chosen[1:]] != seq[chosen[:-1]])))
        start = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
        chosen = chosen[(np.arange(len(chosen)) - start) % 2 == 0]
        alone = self.one_by_one[rank[chosen]]
        if alone.any():
            first = np.concatenate(([True], seq[chosen[1:]] != seq[chosen[:-1]]))
            chosen = chosen[~alone | first]
        return chosen

    def _count_new(self, chunks: list[bytes]) -> dict[bytes, int]:
        owner: list[int] = []
        pretokens: list[str] = []
        base = [0] * len(chunks)
        for i, chunk in enumerate(chunks):
            text = chunk.decode()
            parts = [text]
            if self._special and self._special.search(text):
                parts = self._special.split(text)
                base[i] = len(parts) - 1
            for part in parts:
                for p, _ in self._split(self._normalize(part)) if part else ():
                    owner.append(i)
                    pretokens.append(p)
        total = np.array(base, dtype=np.int64)
        np.add.at(total, np.array(owner, dtype=np.int64), self.survivors(pretokens))
        return dict(zip(chunks, total.tolist(), strict=True))

    def count(self, texts: Iterable[bytes | None]) -> list[int]:
        """Tokens of each text.  ASCII white space always ends a pre-token, so texts are counted by chunk."""
        words = [t.split() if t else [] for t in texts]
        wanted: set[bytes] = set()
        for w in words:
            wanted.update(w)
        count_of = self._cache.serve(wanted, self._count_new).__getitem__
        return [sum(map(count_of, w)) for w in words]


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 2048) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens).  Rows with a null or
    repeated id each give a row of their own; other columns are not read, so
    their names cannot clash.  An empty table gives an empty result.  No
    begin, end or padding tokens are added; special strings inside a text
    count one token each, as the library does by default.
    """
    definition = read_bytes(tokenizer_path)
    shipped = ship(docs.sparkSession, definition, len(definition))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition = shipped.value
        merger = resident((RankMerger, hash(definition)), lambda: RankMerger(definition))
        for batch in batches:
            tokens, sizes = [], []
            for _, _, texts in text_slices(batch.column(1)):
                tokens += merger.count(texts)
                sizes += [len(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = on_workers(docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))).mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_column), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
