"""Sharding by balanced label propagation.

Documents are linked when their texts are equal.  The links of a group form a
clique, so its documents are kept as units, one per group and cell (a hash of
the id), and a unit carries a count; a group of any size has at most ``CELLS``
units.  Labels start at the cell's shard.  In each round every linked unit looks
at the votes of its group, the documents per shard, and asks to move to the
shard with most votes that can take the group; moves into a shard are granted
in hash order up to the room it has left; the rounds end when no move is granted.
Groups that a shard could hold but that are still spread, or that lie in a shard
beyond its quota, are then seated whole where there is most room.  Groups
larger than a shard and unlinked documents fill every shard to its exact quota.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CELLS = 64
BUCKETS = 1024
_GROUP = ["text_hash", "text_crc32", "size"]


def _propagate(units: DataFrame, shards: int, quota: int, max_rounds: int) -> DataFrame:
    """New shards of the linked ``units(group…, cell, n, total, shard)``."""
    for _ in range(max_rounds):
        votes = units.groupBy(*_GROUP, "shard").agg(F.sum("n").alias("votes"), F.max("total").alias("total"))
        load = dict(votes.groupBy("shard").agg(F.sum("votes")).collect())  # one row a shard
        room = F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, max(0, quota - (load.get(s) or 0))))), F.col("shard"))
        # whole groups that fit come before shards that can only take a part; a shard that is full takes none
        fits = (room >= F.col("total") - F.col("votes")).cast("int")
        turn = F.pmod(F.col("shard") - F.pmod(F.col("text_hash"), F.lit(shards)), F.lit(shards))
        order = F.struct(fits.alias("fits"), F.col("votes"), (-turn).alias("turn"), F.col("shard").alias("to"))
        open_votes = votes.filter((room > 0) | (F.col("votes") == F.col("total")))
        wish = open_votes.groupBy(*_GROUP).agg(F.max(order).alias("best")).select(*_GROUP, F.col("best.to").alias("to"), F.col("best.votes").alias("to_votes"))
        here = votes.select(*_GROUP, "shard", F.col("votes").alias("own_votes"))
        asked = units.join(materialize(wish), _GROUP, "left").join(materialize(here), [*_GROUP, "shard"])
        moves = (F.col("to") != F.col("shard")) & (F.col("own_votes") <= F.col("to_votes"))
        # large groups are granted by unit and after all others, so that they cannot hold them up
        big = F.col("total") > quota // 4
        bucket = (F.pmod(F.when(big, F.xxhash64("text_hash", "cell")).otherwise(F.xxhash64("text_hash")), F.lit(BUCKETS)) + big.cast("int") * BUCKETS).cast("int")
        asked = materialize(asked.withColumn("moves", F.coalesce(moves, F.lit(False))).withColumn("bucket", bucket))
        demand = asked.filter("moves").groupBy("to", "bucket").agg(F.sum("n").alias("n"))
        running = demand.withColumn("upto", F.sum("n").over(Window.partitionBy("to").orderBy("bucket")))
        granted = running.filter(F.col("upto") <= F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, max(0, quota - (load.get(s) or 0))))), F.col("to")))
        granted = granted.select("to", "bucket", F.lit(True).alias("granted"))  # at most 2 x shards x BUCKETS rows
        moved = asked.join(F.broadcast(granted), ["to", "bucket"], "left")
        go = F.col("moves") & F.coalesce("granted", F.lit(False))
        units = materialize(moved.select(*_GROUP, "cell", "n", "total", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard"), go.alias("go")))
        if units.filter("go").isEmpty():
            break
        units = units.drop("go")
    else:
        raise RuntimeError(f"labels did not settle in {max_rounds} rounds")
    return units.drop("go")


def _seat(units: DataFrame, shards: int, quota: list[int]) -> DataFrame:
    """``group…, seat`` of the groups of ``units(group…, cell, n, total, shard)`` that are placed whole.

    Groups in one shard keep it as far as it has room; the others go by size to
    the shard with most room.  How many of which size go where is settled on
    counts, and which ones by hash order.
    """
    spread = F.when(F.min("shard") == F.max("shard"), F.min("shard")).otherwise(-1)
    groups = materialize(units.groupBy(*_GROUP).agg(F.max("total").alias("total"), spread.alias("seat")).filter(F.col("total") <= min(quota)))
    counts = {(r.seat, r.total): r.n for r in groups.groupBy("seat", "total").agg(F.count("*").alias("n")).collect()}  # sizes, not groups
    room = list(quota)
    for (seat, total), n in counts.items():
        if seat >= 0:
            room[seat] -= n * total
    homeless: dict[tuple[int, int], int] = {k: n for k, n in counts.items() if k[0] < 0}
    for (seat, total), n in sorted(counts.items()):
        if seat >= 0 and room[seat] < 0:
            leave = min(n, -(room[seat] // total))
            room[seat] += leave * total
            homeless[seat, total] = leave
    if not homeless:
        return groups.select(*_GROUP, "seat")
    heap = [(-r, s) for s, r in enumerate(room)]
    heapq.heapify(heap)
    runs = defaultdict(list)  # (seat, total): [first rank, last rank, shard]
    for (seat, total), n in sorted(homeless.items(), key=lambda x: (-x[0][1], x[0][0])):
        for rank in range(1, n + 1):
            r, s = heap[0]
            to = s if -r >= total else None
            if to is not None:
                heapq.heapreplace(heap, (r + total, s))
            if runs[seat, total] and runs[seat, total][-1][2] == to:
                runs[seat, total][-1][1] = rank
            else:
                runs[seat, total].append([rank, rank, to])
    moves = units.sparkSession.createDataFrame([(seat, total, a, b, to) for (seat, total), own in runs.items() for a, b, to in own], "seat int, total long, a long, b long, to int")
    moving = groups.join(F.broadcast(moves.select("seat", "total").distinct()), ["seat", "total"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("seat", "total").orderBy("text_hash", "text_crc32", "size"))
    ranked = moving.withColumn("rank", rank).join(F.broadcast(moves), ["seat", "total"]).filter(F.col("rank").between(F.col("a"), F.col("b")))
    moved = materialize(ranked.select(*_GROUP, "to"))
    stay = groups.join(moved, _GROUP, "left_anti").select(*_GROUP, "seat")
    return stay.union(moved.filter("to is not null").select(*_GROUP, F.col("to").alias("seat")))


def _choose(value: Column, bounds: list[tuple[int, int]]) -> Column:
    """The first ``then`` whose ``bound`` exceeds ``value``."""
    out = F.lit(None).cast("int")
    for bound, then in reversed(bounds):
        out = F.when(value < bound, F.lit(then)).otherwise(out)
    return out


def shard_documents(docs: DataFrame, *, shards: int = 8, max_rounds: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``rows``: shard counts differ by one at most.  ``size`` is the
    UTF-8 bytes of the text plus one; a null text has no bytes and is grouped
    with empty texts.  Slots run from 0 without gaps in each shard.  Null and
    repeated ids are rows like any other; other columns are not read; an empty
    table gives an empty result.  Groups of equal texts stay together where
    one shard can hold them beside the groups seated before, largest first.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = materialize(rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(CELLS)).cast("int")))
    n_rows = rows.count()
    quota = [n_rows // shards + (s < n_rows % shards) for s in range(shards)]
    units = rows.groupBy(*_GROUP, "cell").agg(F.count("*").alias("n"))
    groups = materialize(units.groupBy(*_GROUP).agg(F.sum("n").alias("total")).filter("total > 1"))
    linked = materialize(units.join(groups, _GROUP).withColumn("shard", F.pmod("cell", F.lit(shards)).cast("int")))
    settled = _propagate(linked, shards, min(quota), max_rounds)
    seats = materialize(_seat(settled, shards, quota))
    # rows of groups that are not seated give way to seated ones, and single rows to both
    placed = settled.join(seats, _GROUP, "left").select(*_GROUP, "cell", F.coalesce("seat", "shard").alias("to"), F.col("seat").isNull().cast("int").alias("unseated"))
    placed = materialize(placed)
    n_buckets = max(64, n_rows // 50_000)
    labelled = rows.join(placed, [*_GROUP, "cell"], "left").select("id", "size", "text_crc32", F.coalesce("to", F.pmod("cell", F.lit(shards)).cast("int")).alias("shard"), F.coalesce("unseated", F.lit(2)).alias("free"), F.pmod(F.xxhash64("id", "text_hash"), F.lit(n_buckets)).alias("bucket"), "text_hash")
    labelled = materialize(labelled)
    cell = ["shard", "free", "bucket"]
    counts = labelled.groupBy(*cell).agg(F.count("*").alias("n"))
    offsets = materialize(counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("free", "bucket")) - F.col("n")).drop("n"))
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("id", "text_hash", "size")) - 1
    ranked = labelled.withColumn("number", number).join(offsets, cell).withColumn("rank", F.col("number") + F.col("before"))
    held = dict(labelled.groupBy("shard").count().collect())  # one row a shard
    kept = [min(held.get(s, 0), quota[s]) for s in range(shards)]
    pool_start, lack, at, used = {}, [], 0, 0
    for s in range(shards):
        pool_start[s] = used
        used += held.get(s, 0) - kept[s]
    for s in range(shards):
        at += quota[s] - kept[s]
        lack.append((at, s))
    by_shard = lambda column, values: F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, values[s]))), column)
    over = F.col("rank") - by_shard(F.col("shard"), quota)
    pool = over + by_shard(F.col("shard"), pool_start)
    dealt = ranked.withColumn("pool", F.when(over >= 0, pool)).withColumn("to", F.when(over >= 0, _choose(F.col("pool"), lack)).otherwise(F.col("shard")))
    first = [kept[s] - (lack[s - 1][0] if s else 0) for s in range(shards)]
    slot = F.when(F.col("pool").isNotNull(), F.col("pool") + by_shard(F.col("to"), first)).otherwise(F.col("rank"))
    return dealt.select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), F.col("to").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
