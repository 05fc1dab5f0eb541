"""Sharding by the minimax contiguous partition, under the law ``bytes``: sizes near equal.

Equal texts are one atomic group. Groups are ordered by the MD5 of their text and
gathered into at most UNITS ranges of that order, which are never cut. A binary search finds the smallest
capacity at which a greedy walk fits the units into the shards, and the units are cut there.
A unit larger than the average shard takes a shard of its own at the front, and the
others share the rest; else it alone would set the capacity and leave shards empty.
The driver holds sums of UNITS ranges, however many documents there are.

Defined results: a null text has no bytes and size 8; very long texts count whole, and one above the average shard gets a shard of its own; only doc_id and text are read, so
other columns can't clash; a null doc_id sorts first, and rows that tie in doc_id, CRC and size are alike; rows
that repeat are rows of their own with slots of their own; an empty table gives no rows;
with fewer units than shards, some shards stay empty.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buckets_for, written

UNITS = 1 << 16
OVERHEAD = 8


def fits(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """The greedy cuts (ends of shards, exclusive) if the units fit; ends: running sums of their sizes."""
    cuts, done, at = [], 0, 0
    while at < len(ends):
        if len(cuts) == shards:
            return None
        nxt = int(np.searchsorted(ends, done + capacity, side="right"))
        if nxt == at:
            return None
        cuts.append(nxt)
        at, done = nxt, int(ends[nxt - 1])
    return cuts


def minimax_cuts(sizes: Sequence[int], shards: int) -> list[int]:
    """Cuts (ends of shards, exclusive) of the contiguous partition whose largest shard is smallest.

    Greedy cuts at the smallest capacity fill the first shards and starve the last, so
    among partitions within it each cut goes to the place nearest to an even share of what is left.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    if not len(ends):
        return []
    low, high = max(int(max(sizes)), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(ends, mid, shards) else (mid + 1, high)
    # must[k]: after k shards at least so many units have to be placed, or the other shards can't hold the rest
    sums, must = np.concatenate([[0], ends]), [len(ends)]
    for _ in range(shards):
        must.insert(0, int(np.searchsorted(sums, sums[must[0]] - low, side="left")))
    cuts, done, at = [], 0, 0
    for k in range(1, shards + 1):
        if at >= len(ends):
            break
        most = int(np.searchsorted(ends, done + low, side="right"))
        want = done + (int(ends[-1]) - done) / (shards - k + 1)
        near = int(np.searchsorted(ends, want, side="left"))
        if near < len(ends) and near > at and want - int(ends[near - 1]) <= int(ends[near]) - want:
            near -= 1
        nxt = min(max(near + 1, must[k], at + 1), most)
        cuts.append(nxt)
        at, done = nxt, int(ends[nxt - 1])
    return cuts


def place_units(sizes: Sequence[int], shards: int) -> list[int]:
    """A shard for each unit."""
    sizes = [int(x) for x in sizes]
    out, own, rest, left = [0] * len(sizes), 0, list(range(len(sizes))), sum(sizes)
    while rest and own < shards - 1:
        big = max(rest, key=lambda i: (sizes[i], -i))
        if sizes[big] * (shards - own) <= left:
            break
        out[big] = own
        own += 1
        left -= sizes[big]
        rest.remove(big)
    start = 0
    for k, end in enumerate(minimax_cuts([sizes[i] for i in rest], shards - own)):
        for i in rest[start:end]:
            out[i] = own + k
        start = end
    return out


def shard(docs: DataFrame, shards: int = 24, units: int = UNITS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs. Two narrow shuffles; texts stay in the scan."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    unit = F.floor(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") * F.lit(units) / float(2**32)).cast("int")
    rows = written(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), unit.alias("unit")), "shard-rows")
    sums = rows.groupBy("unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()  # at most ``units`` rows
    placed = place_units([r["size"] for r in sums], shards)
    buckets = buckets_for(-(-sum(r["n"] for r in sums) // shards))
    where = spark.createDataFrame([(r["unit"], s) for r, s in zip(sums, placed, strict=True)], "unit int, shard int")
    # at most ``units`` rows are broadcast
    rows = rows.join(F.broadcast(where), "unit").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    rows = rows.join(offsets, ["shard", "part"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    rows = shard(docs)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
