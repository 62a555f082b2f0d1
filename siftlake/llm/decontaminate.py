"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds all word sequences of the normalised test items.  Training
words are streamed through it; the state and the longest matching length are
tracked, and wherever that length reaches the window, the last words are a
window of some item.  Items shorter than the window count as one window of
their own length.  Hit spans can be reported or cut out of the texts.

Runs of words whose every adjacent pair occurs in an item are found first with
array lookups, so that only those runs, which alone can hold a window, are
stepped through in Python.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialize, on_workers, resident, ship, text_slices, unload

WINDOW = 10
#: UTF-8 bytes of benchmark text that one automaton holds; of a larger benchmark a worker holds one block after the other against each wide slice of texts.
BLOCK_BYTES = 2 << 20
_WIDE_SLICE_BYTES = 32 << 20
# What is no word character becomes a space, A-Z become lower case.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of ``items`` (id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sequences = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]) for name, text in items]
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        self._window_items: dict[int, set[str]] = {}
        self._short: dict[int, dict[int, set[str]]] = {}
        self.shortest = min((min(len(s), window) for _, s in sequences if s), default=window)
        pairs: set[int] = set()
        size = self._size = len(self.vocab) + 1
        for name, seq in sequences:
            if not seq:
                continue
            pairs.update(a * size + b for a, b in zip(seq, seq[1:], strict=False))
            state = 0
            for i, w in enumerate(seq):
                state = self._next[state][w]
                if i + 1 >= window:
                    self._window_items.setdefault(self._holding(state, window), set()).add(name)
            if len(seq) < window:
                self._short.setdefault(self._holding(state, len(seq)), {}).setdefault(len(seq), set()).add(name)
        self._pairs = np.array(sorted(pairs), dtype=np.int64)

    def _extend(self, last: int, w: int) -> int:
        """Append ``w`` to the item that ends in state ``last``."""
        nexts, link, length = self._next, self._link, self._length
        if w in nexts[last]:
            target = nexts[last][w]
            return target if length[target] == length[last] + 1 else self._split(last, w, target)
        new = self._state(length[last] + 1)
        p = last
        while p >= 0 and w not in nexts[p]:
            nexts[p][w] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            target = nexts[p][w]
            link[new] = target if length[target] == length[p] + 1 else self._split(p, w, target)
        return new

    def _state(self, length: int) -> int:
        self._next.append({})
        self._link.append(0)
        self._length.append(length)
        return len(self._link) - 1

    def _split(self, p: int, w: int, target: int) -> int:
        """A copy of ``target`` for the sequences up to the length that ``p`` and ``w`` make."""
        copy = self._state(self._length[p] + 1)
        self._next[copy] = dict(self._next[target])
        self._link[copy] = self._link[target]
        self._link[target] = copy
        while p >= 0 and self._next[p].get(w) == target:
            self._next[p][w] = copy
            p = self._link[p]
        return copy

    def _holding(self, state: int, length: int) -> int:
        """The state among ``state`` and its suffixes that holds the sequence of the last ``length`` words."""
        while self._length[self._link[state]] >= length:
            state = self._link[state]
        return state

    def _walk(self, ids: list[int], offset: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        nexts, link, length, window = self._next, self._link, self._length, self.window
        state = matched = 0
        for i, w in enumerate(ids):
            while state and w not in nexts[state]:
                state = link[state]
                matched = length[state]
            if w not in nexts[state]:
                continue
            state, matched = nexts[state][w], matched + 1
            hit = 0
            if matched >= window:
                hit = window
                items |= self._window_items.get(self._holding(state, window), set())
            if self._short:
                s, top = state, matched
                while s:
                    for m, names in self._short.get(s, {}).items():
                        if m <= top:
                            hit = max(hit, m)
                            items |= names
                    s = link[s]
                    top = length[s]
            if hit:
                start, end = offset + i + 1 - hit, offset + i + 1
                if spans and start <= spans[-1][1]:
                    start = min(start, spans[-1][0])
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                spans.append((start, end))

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Merged word spans that are hit, and the items that occur, for each document."""
        found: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        if not self.vocab or not docs:
            return found
        lengths = np.fromiter((len(d) + 1 for d in docs), dtype=np.int64, count=len(docs))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        ids = np.full(starts[-1], -1, dtype=np.int64)
        get = self.vocab.get
        for d, s in zip(docs, starts.tolist(), strict=False):
            if d:
                ids[s : s + len(d)] = [get(w, -1) for w in d]
        if self.shortest > 1:
            key = ids[:-1] * self._size + ids[1:]
            at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
            good = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self._pairs[at] == key)
            need, extra = self.shortest - 1, 1
        else:
            good, need, extra = ids >= 0, 1, 0
        edge = np.diff(np.concatenate(([0], good.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = b - a >= need
        a, b = a[keep], b[keep] + extra
        owner = np.searchsorted(starts, a, side="right") - 1
        for lo, hi, d in zip(a.tolist(), b.tolist(), owner.tolist(), strict=True):
            self._walk(ids[lo:hi].tolist(), lo - int(starts[d]), *found[d])
        return found


def _automaton(shipped, key: str, window: int) -> ItemAutomaton:
    """A worker holds one block's automaton at a time, and not the items it is made of."""

    def build() -> ItemAutomaton:
        made = ItemAutomaton(shipped.value, window)
        unload(shipped)
        return made

    return resident((ItemAutomaton, key), build)


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int, window: int) -> list:
    """Broadcasts of the items, each of about ``block_bytes``, with a name for what is in them."""
    items = benchmark.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(text_column).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n > 1:  # sorted by block, so that each is read alone
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartitionByRange(n, "block"))
    out = []
    for k in range(n):
        part = items if n == 1 else items.filter(F.col("block") == k)
        rows = sorted({(r[0], r[1].encode()) for r in part.select("item", "text").toLocalIterator()})
        key = hashlib.sha256(repr((window, rows)).encode()).hexdigest()
        out.append((ship(benchmark.sparkSession, rows, sum(len(t) + len(i) for i, t in rows)), key))
        unload(out[-1][0])
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words in ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def scan_documents(docs: DataFrame, benchmark: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, span_limit: int = 1, coverage_limit: float = 0.5, with_text: bool = False) -> DataFrame:
    """Hold every text of ``docs`` against the items of ``benchmark``.

    Gives the ``keep`` columns, ``n_words``, ``n_hit``, ``items`` (sorted ids of the
    items with an occurring window), and with ``with_text`` also ``clean_text`` (the
    text without hit spans of at least ``span_limit`` words; null for a null
    text) and ``over_coverage`` (more than ``coverage_limit`` of the words are hit).

    A null or word-less text has no words and no hits.  Items without words
    match nothing, repeated items count once by id, a null item id reads as the
    empty string.  Repeated documents each give a row; columns not in ``keep``
    are not read; empty tables are allowed on either side.  An item must fit a
    broadcast (64 MB; an error beyond).
    """
    parts = _blocks(benchmark, item_column, item_text_column, block_bytes, window)
    k = len(keep)
    names = [f"k{i}" for i in range(k)]
    extra = ["clean_text", "over_coverage"] if with_text else []
    tail = ["n_words long", "n_hit long", "items array<string>", *(["clean_text string", "over_coverage boolean"] if with_text else [])]
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), *tail])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(k), SLICE_BYTES if len(parts) == 1 else _WIDE_SLICE_BYTES):
                merged: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in texts]
                n_words = [0] * len(texts)
                for shipped, key in parts:
                    automaton = _automaton(shipped, key, window)
                    for lo, hi, some in _small_slices(texts):
                        words = [words_of(t) for t in some]
                        n_words[lo:hi] = map(len, words)
                        for i, (spans, items) in enumerate(automaton.scan(words), lo):
                            if spans:
                                merged[i] = _union([*merged[i][0], *spans]) if merged[i][0] else spans, merged[i][1] | items
                n_hit = [sum(y - x for x, y in spans) for spans, _ in merged]
                columns = [batch.column(i).slice(a, b - a) for i in range(k)]
                columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(items) for _, items in merged], pa.list_(pa.string()))]
                if with_text:
                    clean = []
                    for t, (spans, _) in zip(texts, merged, strict=True):
                        long = [s for s in spans if s[1] - s[0] >= span_limit]
                        clean.append(cut(t, long).decode() if long else None if t is None else t.decode())
                    columns += [pa.array(clean, pa.string()), pa.array([h > coverage_limit * w for h, w in zip(n_hit, n_words, strict=True)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_hit", "items", *extra])

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text_column).cast("string").alias("text_in"))
    found = on_workers(rows).mapInArrow(run, schema)
    return found.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "n_words", "n_hit", "items", *extra)


def _small_slices(texts: list[bytes | None]) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Consecutive ranges of ``texts`` with about ``SLICE_BYTES`` each."""
    start = total = 0
    for i, t in enumerate(texts):
        size = len(t or b"")
        if i > start and total + size > SLICE_BYTES:
            yield start, i, texts[start:i]
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts), texts[start:]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def oracle() -> str:
    """DuckDB SQL for the digest of ``scan_documents`` with the default window over ``documents`` and ``benchmark``."""
    words = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words("text")}, []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(generate_series(1, len(w) - least({WINDOW}, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, item, places.n, p FROM places JOIN windows ON places.k = windows.k AND places.n = windows.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""
