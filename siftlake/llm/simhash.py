"""SimHash near-duplicates by anchor-point covering.

Two fingerprints that differ in at most three bits differ in at most one bit
of one half.  In each 32-bit half the anchors are the words of the (31, 26)
Hamming code with a free top bit: every half lies within distance 1 of its home
anchor (the covering radius).  A fingerprint is kept at its home anchor and
replicated to every anchor within covering radius plus threshold, 2 bits, which
are at most 17; whoever is within one bit of it has a home among them.  Homes
and replicas are compared per anchor on all 64 bits.

Three bits cover (almost) exact copies alone: at a shingle Jaccard similarity of
0.8 about ten bits differ.  With ``similarity`` given, all pairs of texts that
reach it are linked as well, by an exact prefix join: of two sets that are
similar enough, the least ``n - ceil(similarity * n) + 1`` shingle hashes of
each have one in common.  Candidates are bounded by the number of hashes they
share there, and what is left is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, fresh, materialize, on_workers, release, settled, ship, shuffled, sweep, text_slices, trim, with_text
from .components import components

THRESHOLD = 3
_HALF = 0xFFFFFFFF
_CHUNK = 1 << 16
_PARITIES = ("q0", "q1", "q2", "q3")
#: Pairs for each row that are too many: then, for some rounds, hashes that more sets than ``_HOT`` meet under are put last.  Results don't depend on it.
_PAIRS_A_ROW, _HOT, _HOT_ROUNDS = 4, 8, 2
#: Pairs for each row that are too many after that: then, for some rounds, sets are held against one alone.  Results don't depend on it.
_PAIRS_A_ROW_AFTER, _STAR_ROUNDS = 64, 3
#: Hashes that are put last in a round at most: eight bytes each in the driver and in a worker.
_HOT_KEYS = 1 << 20
#: Bits of a bitmap of hashes: for each hash that it is made for, and at most, which is 32 MB.  Results don't depend on it.
_BITS_A_KEY, _MAP_BITS = 16, 1 << 28
#: Bits of the five parity checks: bit p-1 takes part in check j if p has bit j.
_CHECKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _flips(syndrome: int) -> list[int]:
    """All changes of at most two bits of a half with this syndrome that end at an anchor."""
    found = []
    for n in range(3):
        for places in combinations(range(32), n):
            s = 0
            for p in places:
                s ^= p + 1 if p < 31 else 0
            if s == syndrome:
                found.append(sum(1 << p for p in places))
    return found


def _hashes(text: bytes | None, width: int) -> np.ndarray:
    """The eight hash bytes of each ``width``-word shingle, one row a shingle; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(42))), dtype=np.uint8).reshape(-1, 8)


def _majority(hashes: np.ndarray) -> bytes:
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprint(text: bytes | None, width: int = 3) -> bytes:
    """Eight bytes: a bit is 1 if set in over half of the hashes of all ``width``-word shingles."""
    return _majority(_hashes(text, width))


def _set_of(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The sorted distinct shingle hashes, and a hash that names the set."""
    own = np.unique(hashes.reshape(-1).view(np.int64))
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63), own


def _parities(own: np.ndarray) -> np.ndarray:
    """For each of 256 classes of hashes, whether the set has an odd number of them; two sets differ in as many classes as they differ in hashes, at most."""
    odd = (np.bincount(own & 255, minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def _prefix_size(n: int, similarity: float) -> int:
    """Of two similar sets, prefixes of this size in any common order share something."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def fingerprints(docs: DataFrame, *, width: int = 3, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text", similarity: float | None = None) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a long, for every row of ``docs``.

    With ``similarity`` also ``s``, which names the set of shingles, ``n``, its size, ``prefix``, its least hashes, and its parities.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            prints, names, sizes, prefixes, parities = [], [], [], [np.zeros(0, dtype=np.int64)], []
            for _, _, texts in text_slices(batch.column(at)):
                for t in texts:
                    hashes = _hashes(t, width)
                    prints.append(_majority(hashes))
                    if similarity is not None:
                        name, own = _set_of(hashes)
                        names.append(name)
                        sizes.append(len(own))
                        parities.append(_parities(own))
                        prefixes.append(own[: _prefix_size(len(own), similarity)])
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(np.frombuffer(b"".join(prints), dtype=">i8").astype(np.int64))]
            if similarity is not None:
                ends = np.cumsum([len(x) for x in prefixes]).astype(np.int32)
                columns += [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes)))]
                columns += [pa.array(x) for x in np.array(parities, dtype=np.int64).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f"k{i}" for i in range(len(keep))), "fp", *more])
        trim()

    more = [] if similarity is None else ["s", "n", "prefix", *_PARITIES]
    handed, at = with_text(keep, text_column)
    schema = ", ".join([*(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keep)), "fp long", *([] if similarity is None else ["s long", "n long", "prefix array<long>", *(f"{x} long" for x in _PARITIES)])])
    rows = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(handed)))
    return on_workers(rows).mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "fp", *more)


def _shingle_sets(docs: DataFrame, width: int, text_column: str) -> DataFrame:
    """``s, own``: each distinct set of shingle hashes once, by its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                sets = [_set_of(_hashes(t, width)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in sets], pa.int64()), pa.array([own for _, own in sets], pa.list_(pa.int64()))], names=["s", "own"])
                del sets
        trim()

    return on_workers(docs.select(text_column)).mapInArrow(run, "s long, own array<long>").dropDuplicates(["s"])


def _rooted(sets: DataFrame, known: DataFrame) -> DataFrame:
    """``s, comp``: the least fingerprint that ``known(u, v)`` links with that of each of ``sets(s, fp)``."""
    roots = settled(lambda: components(known).select(F.col("node").alias("fp"), "root"))
    return materialize(sets.select("s", "fp").join(bounded(roots), "fp", "left").select("s", F.coalesce("root", "fp").alias("comp")))


def _may_be_similar(similarity: float) -> Column:
    """Whether sizes and parities of two sets, named ``_u`` and ``_v``, allow the similarity: what they don't share shows in the parities."""
    enough = (F.col("n_u") + F.col("n_v")) * (similarity / (1 + similarity)) - 1e-6
    differ = sum((F.bit_count(F.col(f"{x}_u").bitwiseXOR(F.col(f"{x}_v"))) for x in _PARITIES), F.lit(0))
    return (F.least("n_u", "n_v") >= enough) & (F.col("n_u") + F.col("n_v") - differ >= 2 * enough)


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, *, width: int, similarity: float, content: str, text_column: str) -> DataFrame:
    """``u, v``: fingerprints of those ``pairs(s_u, s_v)`` whose sets are similar enough; texts are read again for what sizes and parities allow."""
    side = lambda x: sets.select(*(F.col(c).alias(f"{c}_{x}") for c in ("s", "fp", "n", *_PARITIES)))
    both = pairs.join(side("u"), "s_u").join(side("v"), "s_v").filter(_may_be_similar(similarity))
    both = materialize(both.select("s_u", "s_v", "fp_u", "fp_v", "n_u", "n_v"))
    wanted = both.select(F.col("s_u").alias("s")).union(both.select(F.col("s_v").alias("s"))).distinct()
    texts = materialize(sets.join(wanted, "s", "left_semi").select(content))
    own = materialize(_shingle_sets(docs.join(bounded(texts), content, "left_semi"), width, text_column))
    of = lambda x: shuffled(own.select(F.col("s").alias(f"s_{x}"), F.col("own").alias(f"own_{x}")))
    found = both.join(of("u"), "s_u").join(of("v"), "s_v").withColumn("common", F.size(F.array_intersect("own_u", "own_v")))
    return materialize(found.filter(F.col("common") / (F.col("n_u") + F.col("n_v") - F.col("common")) >= similarity).select(F.col("fp_u").alias("u"), F.col("fp_v").alias("v")))


def _among(own: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``own`` are among the sorted ``known``; nothing of the size of ``known`` is made, as this is asked for each text."""
    if not len(known):
        return np.zeros(len(own), dtype=bool)
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def _extensions(docs: DataFrame, hot: np.ndarray, *, width: int, similarity: float, text_column: str) -> DataFrame:
    """``s, key, pos``: hashes that enter the prefixes of sets, and at which place, once the ``hot`` ones (sorted) come last in the order of all hashes; hot ones left in a prefix are among them."""
    shipped = ship(docs.sparkSession, hot, hot.nbytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hot = shipped.value
        for batch in batches:
            names, keys, places = [], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
            for _, _, texts in text_slices(batch.column(0)):
                for t in texts:
                    name, own = _set_of(_hashes(t, width))
                    p = _prefix_size(len(own), similarity)
                    late = _among(own, hot)
                    if n := int(late[:p].sum()):
                        keys.append(np.concatenate((own[~late], own[late]))[p - n : p])
                        places.append(np.arange(p - n, p, dtype=np.int32))
                        names += [name] * n
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], names=["s", "key", "pos"])
        trim()

    return on_workers(docs.select(text_column)).mapInArrow(run, "s long, key long, pos int").distinct()


def _hot_keys(met: DataFrame) -> DataFrame:
    """Hashes under which more than ``_HOT`` sets meet; if these are very many, the most frequent of them."""
    counts = materialize(met.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > _HOT))
    least = _HOT
    while counts.filter(F.col("m") > least).count() > _HOT_KEYS:
        least *= 2
    return counts.filter(F.col("m") > least).select("key")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Words of a bitmap with a bit for each of the hashes ``keys(key)``, at the place that its low bits name; it is made by the executors, so the driver gets no more than twice its size."""
    bits = min(_MAP_BITS, max(64, 1 << (_BITS_A_KEY * keys.count() - 1).bit_length()))
    at = F.col("key").bitwiseAND(F.lit(bits - 1))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits >> 6, dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def _marked(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of those ``hashes`` whose bit the bitmap ``known`` has."""
    found = [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(hashes), _CHUNK):
        at = hashes[i : i + _CHUNK] & (64 * len(known) - 1)
        found.append(i + np.flatnonzero(known[at >> 6] >> (at & 63) & 1))
    return np.concatenate(found)


def _among_prefixes(prefixes: DataFrame, keys: DataFrame) -> DataFrame:
    """``s, key, pos`` of those hashes of ``prefixes(s, prefix)`` that are among ``keys(key)``; most others go by a bitmap before anything is shuffled."""
    known = _bitmap(keys)
    shipped = ship(prefixes.sparkSession, known, known.nbytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            hashes = batch.column(1).flatten().to_numpy()
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            found = _marked(shipped.value, hashes)
            row = np.searchsorted(ends, found, side="right")
            starts = np.concatenate(([0], ends))[row]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(hashes[found]), pa.array((found - starts).astype(np.int32))], names=["s", "key", "pos"])
        trim()

    possible = on_workers(prefixes.select("s", "prefix")).mapInArrow(run, "s long, key long, pos int")
    return possible.join(bounded(keys), "key", "left_semi")


def _live(rows: DataFrame) -> DataFrame:
    """Hashes ``key`` that several sets of ``rows(s, key)`` have."""
    live = materialize(rows.groupBy("key").agg(F.min("s").alias("least"), F.max("s").alias("most")).filter("least < most").select("key"))
    sweep(rows.sparkSession)
    return live


def _once(rows: DataFrame) -> DataFrame:
    """``rows(s, key, pos)``, each once; copies of a set may be among them."""
    # written before repeats go: else they would go within the partitions of a join, and Spark couldn't split those of a frequent key
    return materialize(rows).dropDuplicates(["s", "key"])


def _sorted_keys(keys: DataFrame) -> np.ndarray:
    """The hashes ``keys(key)`` in order, without a Python object for each."""
    return np.sort(keys.toArrow().column("key").to_numpy())


def _pairs_to_come(at: DataFrame) -> tuple[float, float]:
    """Rows ``at(key, comp)`` of hashes under which several components meet, and pairs of sets of different components there."""
    inside = at.groupBy("key", "comp").agg(F.count("*").cast("double").alias("m"))
    by_key = inside.groupBy("key").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("square"))
    by_key = by_key.select("m", ((F.col("m") * F.col("m") - F.col("square")) / 2).alias("pairs")).filter("pairs > 0")
    return tuple(by_key.agg(F.coalesce(F.sum("m"), F.lit(0.0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first())


def similar_links(docs: DataFrame, prints: DataFrame, near: DataFrame, *, width: int, similarity: float, content: str, text_column: str = "text") -> DataFrame:
    """``u, v`` with ``near(u, v)`` and links enough that all texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more are in one component.

    ``prints(content, fp, s, n, prefix)`` are those of ``docs(content, text)``.
    Candidates are sets that share a hash of their prefixes.  Where too many meet
    under a hash, it is put last in the order that prefixes are taken by (any
    order will do, if it is the same for all), so that passages that many texts
    share give way to what tells the texts apart.  Of groups of near copies, whose
    hashes are all frequent, not all pairs are needed: for some rounds, the sets
    under a hash are held against one that shares most there.  Whatever then lies
    in different components is compared in full.
    """
    verify = {"docs": docs, "width": width, "similarity": similarity, "content": content, "text_column": text_column}
    own = prints.filter("n > 0")
    sets = materialize(own.groupBy("s").agg(F.min("fp").alias("fp"), *(F.first(x).alias(x) for x in ("n", *_PARITIES)), F.min(content).alias(content)))
    same = own.select("s", F.col("fp").alias("v")).distinct().join(sets.select("s", F.col("fp").alias("u")), "s").filter("u < v").select("u", "v")
    known = materialize(near.select("u", "v").union(same))
    comps = _rooted(sets, known)
    prefixes = own.select("s", "prefix")
    first = met = materialize(_once(_among_prefixes(prefixes, _live(own.select("s", F.explode("prefix").alias("key"))))))
    located = lambda: materialize(met.join(bounded(comps), "s"))
    at = located()
    hot = None
    for _ in range(_HOT_ROUNDS):
        sweep(docs.sparkSession)
        n_rows, n_pairs = _pairs_to_come(at)
        if n_pairs <= _PAIRS_A_ROW * n_rows:
            break
        more = _hot_keys(met)
        hot = materialize((more if hot is None else hot.union(more)).distinct())
        sorted_hot = _sorted_keys(hot)  # bounded by _HOT_KEYS a round
        reordered = materialize(first.join(bounded(hot), "key", "left_semi").select("s").distinct().join(sets.select("s", content), "s").select(content))
        texts = docs.join(F.broadcast(reordered), content, "left_semi") if reordered.count() <= BROADCAST_ROWS else docs
        new = materialize(_extensions(texts, sorted_hot, width=width, similarity=similarity, text_column=text_column))
        asked = materialize(new.select("key").distinct().join(bounded(hot), "key", "left_anti"))
        # what stays in a prefix moves up by the hot ones before it; that table is never broadcast, as its lists may be long
        before = materialize(first.join(bounded(hot), "key", "left_semi").groupBy("s").agg(F.collect_set("pos").alias("gone")))
        up = lambda moved: moved.join(shuffled(before), "s", "left").withColumn("pos", F.col("pos") - F.coalesce(F.size(F.filter("gone", lambda x: x < F.col("pos"))), F.lit(0))).drop("gone")  # noqa: B023, E731
        entering = materialize(up(_among_prefixes(prefixes, asked)).unionByName(new))
        entered = _once(entering.join(bounded(_live(entering)), "key", "left_semi"))
        sweep(docs.sparkSession)
        stayed = up(first.join(bounded(hot), "key", "left_anti"))
        met = materialize(stayed.unionByName(entered).dropDuplicates(["s", "key"]))
        at = located()
    tried = None
    for _ in range(_STAR_ROUNDS):
        sweep(docs.sparkSession)
        n_rows, n_pairs = _pairs_to_come(at)
        if n_pairs <= _PAIRS_A_ROW_AFTER * n_rows:
            break
        left = at if tried is None else at.join(tried.select("key", F.col("hub_comp").alias("comp")), ["key", "comp"], "left_anti")
        weight = at.groupBy("s").agg(F.count("*").alias("w"))
        hubs = left.join(weight, "s").groupBy("key").agg(F.max(F.struct("w", "s", "comp")).alias("hub")).select("key", F.col("hub.s").alias("hub_s"), F.col("hub.comp").alias("hub_comp"))
        hubs = materialize(hubs)
        tried = hubs if tried is None else tried.union(hubs)
        star = left.join(hubs, "key").filter("comp <> hub_comp").select(F.least("s", "hub_s").alias("s_u"), F.greatest("s", "hub_s").alias("s_v")).distinct()
        found = _verified(star, sets, **verify)
        if not found.isEmpty():
            known = materialize(known.union(found).distinct())
            comps = _rooted(sets, known)
            at = located()
    meeting = materialize(at.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least < most").select("key"))
    at = at.join(bounded(meeting), "key", "left_semi").join(bounded(sets.select("s", "n", *_PARITIES)), "s")
    at = materialize(at.withColumn("rest", F.col("n") - F.col("pos")).drop("pos"))
    u, v = (at.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("s", "n", "rest", "comp", *_PARITIES))) for x in "uv")
    sweep(docs.sparkSession)
    enough = (F.col("n_u") + F.col("n_v")) * (similarity / (1 + similarity)) - 1e-6
    behind = F.least("rest_u", "rest_v")
    # what two similar sets share lies before or behind any one hash of that; this holds for all that they share, so that it can be counted
    placed = F.least(F.col("n_u") - F.col("rest_u"), F.col("n_v") - F.col("rest_v")) + behind >= enough
    pairs = u.join(shuffled(v), "key").filter((F.col("s_u") < F.col("s_v")) & (F.col("comp_u") != F.col("comp_v")) & placed & _may_be_similar(similarity))
    pairs = pairs.groupBy("s_u", "s_v").agg(F.count("*").alias("common"), F.max(behind).alias("behind"), F.max("n_u").alias("n_u"), F.max("n_v").alias("n_v"))
    # it lies behind the first; and what isn't common to the prefixes lies behind the prefix that ends first
    after = F.ceil(F.greatest("n_u", "n_v") * F.lit(similarity) - 1e-9) - 1
    pairs = pairs.filter((F.col("behind") >= enough) & (F.col("common") + after >= enough)).select("s_u", "s_v")
    return known.union(_verified(pairs, sets, **verify))


def _half(block: int) -> Column:
    return (F.shiftrightunsigned("fp", 32) if block else F.col("fp")).bitwiseAND(F.lit(_HALF))


def _syndrome(half: Column) -> Column:
    parity = [F.bit_count(half.bitwiseAND(F.lit(m))).cast("int").bitwiseAND(F.lit(1)) for m in _CHECKS]
    total = parity[0]
    for j, p in enumerate(parity[1:], 1):
        total = total + F.shiftleft(p, j)
    return total


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``u < v`` of the distinct fingerprints ``prints(fp)`` that differ in one to three bits, each once."""
    # home flips by syndrome: none, or the one bit that the syndrome names
    home = F.array(*(F.lit(1 << s - 1 if s else 0).cast("long") for s in range(32)))
    near = F.array(*(F.array(*(F.lit(x).cast("long") for x in _flips(s))) for s in range(32)))

    def at(block: int, flips: Column) -> Column:
        return flips.bitwiseXOR(_half(block)).bitwiseXOR(F.lit(block << 32).cast("long"))

    homes = replicas = None
    for block in (0, 1):
        s = _syndrome(_half(block))
        h = prints.select(F.col("fp").alias("u"), at(block, F.get(home, s)).alias("anchor"))
        r = prints.select("fp", F.explode(F.get(near, s)).alias("flip")).select(F.col("fp").alias("v"), at(block, F.col("flip")).alias("anchor"))
        homes, replicas = (h, r) if homes is None else (homes.union(h), replicas.union(r))
    differ = F.col("u").bitwiseXOR(F.col("v"))
    # a pair may meet in both halves: it is taken in the first if it is within one bit there, else in the second
    first = (F.col("anchor") < F.lit(1 << 32)) == (F.bit_count(differ.bitwiseAND(F.lit(_HALF))) <= 1)
    # a fingerprint has some 33 replicas, which Spark's estimate leaves out
    pairs = homes.join(shuffled(replicas.withColumnRenamed("anchor", "replica_anchor")), (F.col("anchor") == F.col("replica_anchor")) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= THRESHOLD) & first)
    return pairs.select("u", "v")


def near_classes(docs: DataFrame, *, keep: tuple[str, ...], width: int = 3, text_column: str = "text", similarity: float | None = None) -> DataFrame:
    """The ``keep`` columns, ``fp`` and ``root``, the least fingerprint of the row's component, for every row of ``docs``."""
    content = fresh(docs, "content")
    docs = docs.withColumn(content, F.xxhash64(text_column))
    prints = materialize(fingerprints(docs, width=width, keep=(*keep, content), text_column=text_column, similarity=similarity))
    nodes = materialize(prints.select("fp").distinct())
    near = links(nodes)
    if similarity is not None:
        found = near
        near = settled(lambda: similar_links(docs, prints, found, width=width, similarity=similarity, content=content, text_column=text_column))
    roots = settled(lambda: components(near))
    rooted = materialize(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    return prints.join(rooted, "fp").select(*keep, "fp", "root")


def near_duplicates(docs: DataFrame, *, width: int = 3, id_column: str = "doc_id", text_column: str = "text", similarity: float | None = None) -> DataFrame:
    """``id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most three
    differing bits and, with ``similarity``, of at least that Jaccard similarity
    of the texts' shingles.  Texts without words (null, empty, white space) have
    fingerprint zero and link like any other; repeated rows each give a row;
    null ids take part but never name a component that has another id; other
    columns are not read; an empty table gives an empty result.
    """
    rows = materialize(near_classes(docs, keep=(id_column,), width=width, text_column=text_column, similarity=similarity))
    named = materialize(rows.groupBy("root").agg(F.min(id_column).alias("component_id")))
    return rows.join(named, "root").select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
