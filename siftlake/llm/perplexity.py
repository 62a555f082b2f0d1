"""Quality rules with an n-gram perplexity band per language.

The model is a modified Kneser-Ney model over characters (words joined by one
space), of order five, one per language.  Highest-order counts are added up in
each task and by Spark over all documents; continuation counts, discounts and
interpolated probabilities follow by aggregations and joins.  The finished
model is stored as arrays sorted by a 64-bit hash of language and n-gram, in
broadcast blocks of bounded size.

No text vouches for itself: scoring leaves its own n-grams out.  Those that
other texts have too are known; those that it alone has, copies included, are
backed off from, which is why they need no place in the arrays.

Log-probabilities are integers in units of 2**-20, so sums do not depend on the
order of addition, nor on the number of blocks.  Of n-grams that share a 64-bit
hash the lesser log-probability counts.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialize, on_workers, release, resident, settled, ship, text_slices, trim, unload

ORDER = 5
UNIT = 1 << 20
_BITS = 12
_PAD = b" " * (ORDER - 1)
_SYMBOLS = b"#*$%&|<>"
#: Characters that the array code handles at once, and bytes of text that are decoded at once.
_CHUNK = 1 << 19
_SLICE_BYTES = 1 << 20
_WIDE_SLICE_BYTES = 8 << 20
#: N-grams that a worker holds before it puts them out, and rows that it puts out at once.
_HELD = 1 << 19
_ROWS = 1 << 15
#: Bytes of one block of the model, and buckets that contexts are dealt into.
BLOCK_BYTES = 32 << 20
_BUCKET_BITS = 12
#: Bytes of a model entry: hash, log-probability, weight of backing off.
_ENTRY = np.dtype([("hash", "<u8"), ("logp", "<i4"), ("back", "<i4")])


@dataclass(frozen=True)
class Bands:
    """Limits of the mean negative log-probability of a character, per language.

    They lie ``width`` times the distance from the median to the lower and to
    the upper quartile away from the median (12 are eight standard deviations of
    a normal distribution), and at least ``least`` nats.  The quartiles are of
    all documents that pass the base rules, to a hundredth of a nat.  A document
    of n characters has ``noise`` / sqrt(n) nats more on either side, about three
    standard errors of its mean.
    """

    width: float = 12.0
    least: float = 0.15
    noise: float = 4.0


# ---------------------------------------------------------------- texts as arrays


def _stream(words: list[bytes]) -> bytes:
    """The padded character sequence of a document; empty without words."""
    return _PAD + b" ".join(words) + b" " if words else b""


def _codes(stream: bytes) -> np.ndarray:
    return np.frombuffer(stream.decode().encode("utf-32-le"), dtype=np.uint32)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where each starts."""
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, dtype=np.int64)
    return ordered[first], first


class _Counts:
    """Occurrences of all n-grams of the highest order, with the least and the largest hash of the texts that have them.

    N-grams are packed exactly into 64 bits by an alphabet of up to 4095
    characters.  Runs sorted by n-gram are merged when they outgrow what was merged before.
    """

    def __init__(self):
        self._id_of = np.zeros(0x110000, dtype=np.uint16)
        self._characters: list[int] = [0]
        self._runs: list[tuple[np.ndarray, ...]] = []
        self._fresh = 0

    def add(self, streams: list[bytes]) -> bool:
        """False, with nothing added, if the alphabet would overflow."""
        codes = [_codes(s) for s in streams]
        every = np.concatenate(codes)
        missing = every[self._id_of[every] == 0]
        if len(missing):
            new = np.unique(missing)
            if len(self._characters) + len(new) > 1 << _BITS:
                return False
            self._id_of[new] = np.arange(len(self._characters), len(self._characters) + len(new))
            self._characters += new.tolist()
        del every, missing
        for s, c in zip(streams, codes, strict=True):
            for keys, n in self._of_document(self._id_of[c]):
                self._runs.append((keys, n, *[np.full(len(keys), _name_of(s))] * 2))
                self._fresh += len(keys)
        if self._fresh > max(_HELD // 4, len(self._runs[0][0])):
            self._merge()
        return True

    def _merge(self) -> None:
        keys, n, least, most = (np.concatenate(x) for x in zip(*self._runs, strict=True))
        order = np.argsort(keys)
        keys, first = _runs(keys[order])
        n, least, most = (f.reduceat(x[order], first) for f, x in ((np.add, n), (np.minimum, least), (np.maximum, most)))
        self._runs, self._fresh = [(keys, n, least, most)], 0

    def _of_document(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Its n-grams with their occurrences, a chunk at a time."""
        for at in range(0, len(ids) - ORDER + 1, _CHUNK):
            n = min(_CHUNK, len(ids) - ORDER + 1 - at)
            key = np.zeros(n, dtype=np.int64)
            for j in range(ORDER):
                key = (key << _BITS) | ids[at + j : at + j + n]
            key.sort()
            keys, first = _runs(key)
            yield keys, np.diff(np.append(first, n))

    def full(self) -> bool:
        """Whether more n-grams are held than a worker should."""
        return bool(self._runs) and len(self._runs[0][0]) > _HELD

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        self._merge()
        characters = np.array(self._characters, dtype=np.uint32)
        keys, *numbers = self._runs.pop()
        for a in range(0, len(keys), _ROWS):
            part = keys[a : a + _ROWS]
            grid = np.empty((len(part), ORDER), dtype=np.uint32)
            for j in range(ORDER):
                grid[:, j] = characters[(part >> _BITS * (ORDER - 1 - j)) & ((1 << _BITS) - 1)]
            sizes = (1 + (grid >= 1 << 7) + (grid >= 1 << 11) + (grid >= 1 << 16)).sum(axis=1)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            grams = pa.StringArray.from_buffers(len(part), pa.py_buffer(ends), pa.py_buffer(grid.tobytes().decode("utf-32-le").encode()))
            yield _gram_rows(lang, grams, *(x[a : a + _ROWS] for x in numbers))


def _gram_rows(lang: str, grams: pa.StringArray, *numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(grams)), grams, *(pa.array(x, pa.int64()) for x in numbers)], names=["lang", "gram", "c", "least", "most"])


def _name_of(stream: bytes) -> int:
    """A hash that names a text; texts that differ in white space alone have one name."""
    return xxhash.xxh3_64_intdigest(stream) - (1 << 63)


def _grams_of(stream: bytes) -> Counter:
    """The same counts for one document with Python strings (for alphabets of any size)."""
    s = stream.decode()
    return Counter(s[i : i + ORDER] for i in range(len(s) - ORDER + 1))


# ---------------------------------------------------------------- the model, by Spark


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, c, least, most`` over all of ``docs(lang, text)``: occurrences, and the least and the largest hash of the texts that have the n-gram.

    A worker puts out what it has counted whenever it holds many n-grams; Spark adds the parts up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: dict[str, _Counts] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for a, b, texts in text_slices(batch.column(1), _SLICE_BYTES):
                by_lang: dict[str, list[bytes]] = {}
                for lang, t in zip(langs[a:b], texts, strict=True):
                    if t and (words := t.split()):
                        by_lang.setdefault(lang, []).append(_stream(words))
                for lang, streams in by_lang.items():
                    if not held.setdefault(lang, _Counts()).add(streams):
                        yield from held.pop(lang).rows(lang)
                        for s in streams:  # a rare slice with a very large alphabet
                            if not held.setdefault(lang, _Counts()).add([s]):
                                yield from held.pop(lang).rows(lang)
                                grams = _grams_of(s)
                                names, n = list(grams), list(grams.values())
                                for i in range(0, len(n), _ROWS):
                                    part = n[i : i + _ROWS]
                                    yield _gram_rows(lang, pa.array(names[i : i + _ROWS], pa.string()), part, *[[_name_of(s)] * len(part)] * 2)
                    elif held[lang].full():
                        yield from held.pop(lang).rows(lang)
            if len(held) > 16:
                for lang in list(held):
                    yield from held.pop(lang).rows(lang)
        for lang in list(held):
            yield from held.pop(lang).rows(lang)

    counted = on_workers(docs.select("lang", "text")).mapInArrow(run, "lang string, gram string, c long, least long, most long")
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"), F.min("least").alias("least"), F.max("most").alias("most"))


def _discounts(counts: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3`` by the counts of counts; a hundredth at least, so that every context leaves something for unseen n-grams."""
    n = counts.groupBy("lang").agg(*(F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in range(1, 5)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = lambda k: F.greatest(F.lit(0.01), F.least(F.lit(float(k)), F.coalesce(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(k / 2))))
    return n.select("lang", *(d(k).alias(f"d{k}") for k in (1, 2, 3)))


def build_model(grams: DataFrame, *, shared_only: bool = True) -> DataFrame:
    """``lang, gram, logp, back``: rows with the interpolated log-probability of an n-gram's last character, and rows with the log-weight of backing off from it as a context, in units (the other column is null).

    All n-grams make up the counts, continuation counts and discounts.  With
    ``shared_only`` the rows of n-grams and contexts that a single text has (with
    its copies) are left out afterwards: that text alone could ask for them.
    A row with the empty n-gram holds the uniform distribution of its language.
    """
    levels = {ORDER: materialize(grams)}
    names = (F.min("least").alias("least"), F.max("most").alias("most"))
    for k in range(ORDER - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c"), *names))
    unit = lambda p: F.round(F.log(p) * UNIT).cast("int")
    none = F.lit(None).cast("int")
    shared = F.col("least") < F.col("most") if shared_only else F.lit(True)
    lower = materialize(levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).select("lang", F.lit("").alias("gram"), "p"))
    parts = [lower.select("lang", "gram", unit(F.col("p")).alias("logp"), none.alias("back"))]
    for k in range(1, ORDER + 1):
        level = levels[k].join(bounded(materialize(_discounts(levels[k]))), "lang")
        taken = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("lang", "gram", "c", "least", "most", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"), "d1", "d2", "d3", taken.alias("d"))
        kinds = [F.count_if(x).alias(f"k{i}") for i, x in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") >= 3), 1)]
        contexts = level.groupBy("lang", "context").agg(F.sum("c").alias("total"), *names, *kinds, *(F.max(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)))
        contexts = contexts.select("lang", "context", "total", "least", "most", (sum((F.col(f"d{i}") * F.col(f"k{i}") for i in (1, 2, 3)), F.lit(0.0)) / F.col("total")).alias("gamma"))
        contexts = materialize(contexts)
        below = lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("p_rest"))
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("p_rest")
        lower = level.join(contexts.drop("least", "most"), ["lang", "context"]).join(below, ["lang", "rest"]).select("lang", "gram", p.alias("p"), "least", "most")
        lower = materialize(lower)
        parts.append(lower.filter(shared).select("lang", "gram", unit(F.col("p")).alias("logp"), none.alias("back")))
        parts.append(contexts.filter(shared).select("lang", F.col("context").alias("gram"), none.alias("logp"), unit(F.col("gamma")).alias("back")))
    model = parts[0]
    for part in parts[1:]:
        model = model.union(part)
    return materialize(model)


# ---------------------------------------------------------------- the model, as sorted hash arrays

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _PRIME
    return h ^ (h >> np.uint64(29))


def _hash_codes(columns: list[np.ndarray], seed: np.uint64) -> np.ndarray:
    """Hash of the n-grams whose characters are the rows of ``columns``."""
    h = np.full(len(columns[0]) if columns else 1, seed + np.uint64(len(columns)), dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * _PRIME
        h ^= h >> np.uint64(32)
    return _mix(h)


def _bucket(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Bucket of the last two characters of a context."""
    return (_hash_codes([older, newer], np.uint64(7)) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


class HashArrays:
    """Entries sorted by hash, found through a table of the hashes' leading bits."""

    def __init__(self, entries: np.ndarray):
        self.logp, self.back = np.ascontiguousarray(entries["logp"]), np.ascontiguousarray(entries["back"])
        self._hashes = np.append(entries["hash"], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = max(1, int(np.ceil(np.log2(max(2, 2 * len(entries))))))
        self._shift = np.uint64(64 - bits)
        self._start = np.searchsorted(self._hashes[:-1], np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes``; -1 for what is not there."""
        at = self._start[hashes >> self._shift]
        here = self._hashes[at]
        again = np.flatnonzero(here < hashes)
        while len(again):
            at[again] += 1
            here[again] = now = self._hashes[at[again]]
            again = again[now < hashes[again]]
        at[(here != hashes) | (at == len(self.logp))] = -1
        return at

    def nll(self, codes: np.ndarray, seed: np.uint64, out: np.ndarray, mine: np.ndarray | None = None) -> None:
        """Set ``out`` to the negative log-probability, in units, of the last character of each n-gram of highest order in ``codes``.

        With ``mine``, a flag for each bucket, only n-grams whose context is in these buckets are dealt with.
        """
        for a in range(0, len(out), _CHUNK):
            b = min(len(out), a + _CHUNK)
            columns = [codes[a + j : b + j].astype(np.uint64) for j in range(ORDER)]
            if mine is None:
                out[a:b] = self._nll(columns, seed)
            else:
                here = np.flatnonzero(mine[_bucket(columns[ORDER - 3], columns[ORDER - 2])])
                out[a + here] = self._nll([c[here] for c in columns], seed)

    def _nll(self, columns: list[np.ndarray], seed: np.uint64) -> np.ndarray:
        at = self.find(_hash_codes(columns, seed))
        out = np.where(at >= 0, self.logp[at], 0).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        for k in range(ORDER - 1, -1, -1):
            if not len(missing):
                break
            last = [c[missing] for c in columns]
            context = self.find(_hash_codes(last[ORDER - 1 - k : ORDER - 1], seed) if k else np.repeat(_hash_codes([], seed), len(missing)))
            out[missing] += np.where(context >= 0, self.back[context], 0)
            shorter = self.find(_hash_codes(last[ORDER - k :], seed) if k else np.repeat(_hash_codes([], seed), len(missing)))
            known = (shorter >= 0) & (self.logp[shorter] != _ABSENT)
            out[missing[known]] += self.logp[shorter[known]]
            missing = missing[~known]
        return -out


_ABSENT = np.iinfo(np.int32).max


def _merged(entries: np.ndarray) -> np.ndarray:
    """``entries`` sorted by hash, those of one hash made one."""
    entries = entries[np.argsort(entries["hash"])]
    hashes, first = _runs(entries["hash"])
    out = np.empty(len(hashes), dtype=_ENTRY)
    out["hash"] = hashes
    for name in ("logp", "back"):
        out[name] = np.minimum.reduceat(entries[name], first)
    return out


@dataclass
class ModelBlocks:
    """The model in broadcasts of bounded size; n-grams whose contexts end alike are in one block, and what all need is in each."""

    parts: list
    block_of: np.ndarray
    token: str

    def load(self, k: int) -> dict[str, HashArrays]:
        """Block ``k`` by language; a worker holds one block at a time."""

        def build() -> dict[str, HashArrays]:
            loaded = {lang: HashArrays(entries) for lang, entries in self.parts[k].value.items()}
            unload(self.parts[k])
            return loaded

        return resident((ModelBlocks, self.token, k), build)

    def mine(self, k: int) -> np.ndarray | None:
        return None if len(self.parts) == 1 else self.block_of == k


def _hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, entries and buckets (-1: needed in all blocks) of rows of the model."""
    langs = np.array(batch.column(0).to_pylist(), dtype=object)
    grams = np.array(batch.column(1).to_pylist(), dtype=object)
    entries, bucket = np.zeros(len(grams), dtype=_ENTRY), np.full(len(grams), -1, dtype=np.int64)
    entries["logp"] = batch.column(2).fill_null(int(_ABSENT)).to_numpy()
    entries["back"] = batch.column(3).fill_null(0).to_numpy()
    is_context = batch.column(2).is_null().to_numpy(zero_copy_only=False)
    lengths = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    for k in range(ORDER + 1):
        for lang in sorted(set(langs[lengths == k])):
            here = np.flatnonzero((langs == lang) & (lengths == k))
            codes = np.frombuffer("".join(grams[here]).encode("utf-32-le"), dtype=np.uint32).reshape(len(here), k).astype(np.uint64)
            columns = [codes[:, j] for j in range(k)]
            entries["hash"][here] = _hash_codes(columns, _seed(lang)) if k else _hash_codes([], _seed(lang))[0]
            if k >= 2:
                bucket[here] = np.where(is_context[here], _bucket(*columns[-2:]), _bucket(*columns[-3:-1]) if k >= 3 else -1)
    return langs, entries, bucket


def ship_model(model: DataFrame, block_bytes: int = BLOCK_BYTES) -> ModelBlocks:
    """Broadcast ``model`` in as many blocks as it takes for none to exceed ``block_bytes``, one after the other.

    Contexts are dealt out by their last two characters; characters, pairs and
    contexts of one character are in each block.  One block is at most the
    broadcast bound (an error beyond).
    """
    spark, total = model.sparkSession, model.count() * _ENTRY.itemsize
    block_of, n = np.zeros(1 << _BUCKET_BITS, dtype=np.int16), 1
    if total > block_bytes:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for batch in batches:
                buckets, n = np.unique(_hashed(batch)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(n, pa.int64())], names=["bucket", "n"])

        sizes = dict(on_workers(model).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())  # a row a bucket
        common = sizes.pop(-1, 0) * _ENTRY.itemsize
        room = max(block_bytes // 4, block_bytes - common)
        filled, n = 0, 1
        for bucket, rows in sorted(sizes.items()):
            if filled and filled + rows * _ENTRY.itemsize > room:
                filled, n = 0, n + 1
            filled += rows * _ENTRY.itemsize
            block_of[bucket] = n - 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            langs, entries, bucket = _hashed(batch)
            rows = []
            for k in range(n):
                mine = (bucket < 0) | (block_of[bucket] == k)
                rows += [(k, lang, entries[mine & (langs == lang)].tobytes()) for lang in sorted(set(langs[mine]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.string(), pa.binary())], names=["block", "lang", "entries"])

    packed = on_workers(model).mapInArrow(pack, "block int, lang string, entries binary")
    packed = materialize(packed) if n > 1 else packed
    parts = []
    for k in range(n):
        found: dict[str, list[bytes]] = {}
        for _, lang, entries in (packed.filter(F.col("block") == k) if n > 1 else packed).collect():
            found.setdefault(lang, []).append(bytes(entries))
        arrays = {lang: _merged(np.frombuffer(b"".join(found.pop(lang)), dtype=_ENTRY)) for lang in sorted(found)}
        parts.append(ship(spark, arrays, sum(x.nbytes for x in arrays.values())))
        unload(parts[-1])
    return ModelBlocks(parts, block_of, uuid.uuid4().hex)


# ---------------------------------------------------------------- base rules


def _repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that are found twice or more in the text."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        key = _mix(key ^ h[j : j + n]) * _PRIME
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    places = np.flatnonzero(np.isin(key, again)).tolist()
    windows = Counter(tuple(words[i : i + width]) for i in places)
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    for i in places:
        if windows[tuple(words[i : i + width])] > 1:
            hit[i] += 1
            hit[min(i + width, len(words))] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def base_counts(text: bytes | None, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode())
    return len(words), chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), _repeated_words(words)


_BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_BASE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(docs: DataFrame, keep: list[str], model: ModelBlocks) -> DataFrame:
    """The ``keep`` columns, ``lang``, base counts, ``nll`` and ``n_events`` of ``docs(keep…, lang, text)``.

    Of a model in several blocks, a worker goes through all of them for each
    large slice of texts; every n-gram is looked up in one.
    """
    kept = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    n_keep, n_blocks = len(keep), len(model.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(n_keep).to_pylist()
            for a, b, texts in text_slices(batch.column(n_keep + 1), _SLICE_BYTES if n_blocks == 1 else _WIDE_SLICE_BYTES):
                words = [t.split() if t else [] for t in texts]
                base = [base_counts(t, w) for t, w in zip(texts, words, strict=True)]
                nll, events = [0] * (b - a), [0] * (b - a)
                by_lang: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    if w:
                        by_lang.setdefault(langs[a + i], []).append(i)
                codes = {lang: [_codes(_stream(words[i])) for i in at] for lang, at in by_lang.items()}
                ends = {lang: np.cumsum([len(c) for c in own]).tolist() for lang, own in codes.items()}
                codes = {lang: np.concatenate(own) for lang, own in codes.items()}
                del words
                cost = {lang: np.empty(len(own) - ORDER + 1, dtype=np.int32) for lang, own in codes.items()}
                for k in range(n_blocks):
                    arrays = model.load(k) if by_lang else {}
                    for lang, own in codes.items():
                        arrays[lang].nll(own, _seed(lang), cost[lang], model.mine(k))
                for lang, at in by_lang.items():
                    start = 0
                    for i, end in zip(at, ends[lang], strict=True):
                        events[i] = end - start - ORDER + 1
                        nll[i] = int(cost[lang][start : end - ORDER + 1].sum(dtype=np.int64))
                        start = end
                columns = [batch.column(i).slice(a, b - a) for i in range(n_keep + 1)]
                columns += [pa.array(x, pa.int64()) for x in (*zip(*base, strict=True), nll, events)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang", *_BASE_NAMES, "nll", "n_events"])
        trim()

    return on_workers(docs.select(*keep, "lang", "text")).mapInArrow(run, f"{kept}, lang string, {_BASE}, nll long, n_events long")


# ---------------------------------------------------------------- the operator


def _quantile(bins: DataFrame, q: float) -> Column:
    return F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin"))) / 100


def perplexity_bands(measured: DataFrame, bands: Bands) -> DataFrame:
    """``lang, low, high`` from all of ``measured(lang, base_failed, mean_nll)``, by exact histograms."""
    from pyspark.sql import Window

    bins = measured.filter("not base_failed").groupBy("lang", F.floor(F.col("mean_nll") * 100).alias("bin")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(ordered)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    q = bins.groupBy("lang").agg(*(_quantile(bins, x).alias(n) for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))))
    return q.select("lang", (F.col("q50") - F.greatest(F.lit(bands.least), bands.width * (F.col("q50") - F.col("q25")))).alias("low"), (F.col("q50") + F.greatest(F.lit(bands.least), bands.width * (F.col("q75") - F.col("q50")))).alias("high"))


def quality_rules(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", lang_column: str = "lang", bands: Bands = Bands(), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``keep`` columns, base counts, ``base_failed``, ``kept``, ``lang``, ``mean_nll``, ``low``, ``high`` for every row of ``docs``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them in
    repeated five-word windows.  Other documents are kept if the mean negative
    log-probability of their characters lies within their language's band, and
    rejected above and below.  A null text has no words; null and the empty
    string are one language; repeated rows each count in the model and give a
    row; columns not named are not read; an empty table gives an empty result.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    model = ship_model(settled(lambda: build_model(count_grams(rows))), block_bytes)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = _measure(rows, names, model)
    measured = materialize(measured.withColumn("base_failed", failed).withColumn("mean_nll", F.coalesce(F.try_divide(F.col("nll").cast("double"), F.col("n_events") * F.lit(float(UNIT))), F.lit(0.0))))
    limits = bounded(materialize(perplexity_bands(measured, bands)))
    slack = F.coalesce(F.try_divide(F.lit(bands.noise), F.sqrt("n_events")), F.lit(0.0))
    judged = measured.join(limits, "lang", "left").withColumns({"low": F.col("low") - slack, "high": F.col("high") + slack})
    kept = ~F.col("base_failed") & F.coalesce(F.col("mean_nll").between(F.col("low"), F.col("high")), F.lit(False))
    return judged.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *_BASE_NAMES, "base_failed", kept.alias("kept"), F.col("lang").alias("model_lang"), "mean_nll", "low", "high")
