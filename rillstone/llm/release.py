"""Quarantine and cascading release of a conversation's turns, by a backoff lookup table.

A turn waits for its parent, is tried up to five times with growing pauses, and is delivered, dead, or blocked by a
parent that isn't delivered. How many attempts a turn needs depends on two small numbers alone, the repair
time that is left at the first attempt and the mask of random failures, so ``attempts_table``
has the answer for each of them, and no attempt is ever looped over.

No conversation meets in one task, however long it is:

* turns are sorted by range into runs, and a turn's number is its place in the run plus the counts of the runs before;
* a conversation is replayed in blocks of BLOCK turns. A task holds many blocks and goes along the turn order once, gathering parents' deliveries and table entries for
  all blocks at once. Turns that hang on an unknown turn of the block before stay open; they alone are replayed again, with that block's last turns,
  until none is open (a chain ends at each turn by a third, so one more pass is the rule);
* releases are numbered in ranges of time, whose counts and weighted sums give the offsets of later ranges.

Defined results: a null text is empty, a text of any length counts by its CRC alone; a null conv_id is a conversation of its own and a null turn comes first, both
empty strings in a draw; rows that repeat a turn follow each other by their text's CRC, rows that tie in that, too, are alike; an empty table
gives no rows; state is taken modulo 2^64 as a signed long, which is the sum itself below 2^63. Only conv_id, turn and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Seconds between arrivals, most attempts, and the repair times a turn can have: 0 to LONGEST.
STEP, ATTEMPTS, LONGEST = 7, 5, 100
#: Seconds from the first attempt to attempt a + 1.
OFFSETS = np.cumsum([0] + [10 * 2**a for a in range(ATTEMPTS - 1)])
#: Turns of a block, rows of a run on average, and ranges that meet in one window.
BLOCK, RUN, FAN = 128, 65_536, 256
OPEN, DELIVERED, DEAD, BLOCKED = 0, 1, 2, 3
#: A turn hangs on one of the two before it, so a block needs so many turns of the block before.
REACH = 2


def attempts_table() -> np.ndarray:
    """[repair time left, mask]: the attempt that delivers, 0 if none does; bit a - 1 of the mask fails attempt a."""
    left, mask = np.arange(LONGEST + 1)[:, None, None], np.arange(1 << ATTEMPTS)[None, :, None]
    passes = (OFFSETS >= left) & ((mask >> np.arange(ATTEMPTS)) & 1 == 0)
    return np.where(passes.any(axis=2), passes.argmax(axis=2) + 1, 0)


def _draw(k: int) -> Column:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.crc32(F.concat_ws(":", F.lit(str(k)), part("conv_id"), part("turn")).cast("binary"))


def drawn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, a key that isn't null, the text's CRC, and the draws: distance of the parent, repair time, mask of random failures."""
    faulty = _draw(1) % 101 < 35
    mask = sum((F.when(_draw(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0) for a in range(1, ATTEMPTS + 1)), F.lit(0))
    return turns.select(
        "conv_id", "turn",
        F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))).alias("key"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"),
        (_draw(0) % (REACH + 1)).cast("int").alias("distance"),
        F.when(faulty, _draw(2) % (LONGEST + 1)).otherwise(0).cast("int").alias("repair"),
        F.when(faulty, mask).otherwise(0).cast("int").alias("mask"),
    )


def sums_before(counts: DataFrame, index: str, values: dict[str, str], fan: int = FAN) -> DataFrame:
    """counts (a table; one row per key and whole index, from 0) and, under the names in ``values``, the sums of its key's rows with a smaller index.

    Ranges of ``fan`` indexes are summed up first, and ranges of ranges, so a window holds ``fan`` rows at most.
    """
    most = counts.agg(F.max(index)).first()[0] or 0
    earlier = lambda *by: Window.partitionBy("key", *by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    if most < fan:
        return counts.select("*", *[F.coalesce(F.sum(v).over(earlier()), F.lit(0)).alias(out) for v, out in values.items()])
    wide = counts.withColumn("_wide", F.floor(F.col(index) / fan).cast("long"))
    upper = written(wide.groupBy("key", F.col("_wide").alias(index)).agg(*[F.sum(v).alias(v) for v in values]), "release-ranges")
    upper = sums_before(upper, index, values, fan).select("key", F.col(index).alias("_wide"), *[F.col(out).alias(f"_{out}") for out in values.values()])
    inside = [(F.col(f"_{out}") + F.coalesce(F.sum(v).over(earlier("_wide")), F.lit(0))).alias(out) for v, out in values.items()]
    return wide.join(upper.hint("merge"), ["key", "_wide"]).select(*counts.columns, *inside)


def numbered(turns: DataFrame, run: int = RUN) -> DataFrame:
    """drawn(turns) with p, the turn's number in its conversation from 0."""
    spark, rows = turns.sparkSession, turns.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // run))
    # rows that are alike may go to several runs, too: the last sort column tells them apart
    spread = drawn(turns).withColumn("any", F.monotonically_increasing_id())
    runs = written(spread.repartitionByRange(parts, "key", "turn", "crc", "any").withColumn("run", F.spark_partition_id()).drop("any"), "release-runs")
    counts = written(runs.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n")), "release-counts")
    before = sums_before(counts, "run", {"n": "done"}).select("key", "run", "done")
    place = F.row_number().over(Window.partitionBy("key", "run").orderBy("turn", "crc"))
    return runs.join(before.hint("merge"), ["key", "run"]).withColumn("p", F.col("done") + place - 1).drop("run", "done")


_COLUMNS = "status int, attempts int, first_at long, last_at long"


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with what became of them; rows of a block follow each other by p, and those with a status before their block's start are given back no more."""
    table = attempts_table()
    held: pa.Table | None = None

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for part in rows.combine_chunks().to_batches():
            out = replayed(part, table)
            if out.num_rows:
                yield out

    for batch in batches:
        now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not now.num_rows:
            continue
        g = np.asarray(now.column("g").combine_chunks())
        last = int(np.nonzero(g != g[-1])[0].max(initial=-1)) + 1  # the last block may go on
        yield from done(now.slice(0, last))
        held = now.slice(last)
    if held is not None:
        yield from done(held)


def replayed(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """Whole blocks: each turn's status, attempts and times; columns i of the arrays are the turns i - REACH of all blocks."""
    column = {n: np.asarray(batch.column(n).fill_null(0) if batch.column(n).null_count else batch.column(n)) for n in ("g", "p", "start", "distance", "repair", "mask", "status", "last_at")}
    block = np.cumsum(np.concatenate([[0], column["g"][1:] != column["g"][:-1]])) if batch.num_rows else np.zeros(0, dtype=int)
    at = column["p"] - column["start"] + REACH
    shape = (int(block.max(initial=-1)) + 1, int(at.max(initial=-1)) + 1)
    status, last = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=np.int64)
    given = at < REACH
    status[block[given], at[given]], last[block[given], at[given]] = column["status"][given], column["last_at"][given]
    attempts, first = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows, dtype=np.int64)
    by_turn = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[by_turn], np.arange(REACH, shape[1] + 1))
    for i in range(REACH, shape[1]):  # along the turn order, all blocks at once
        rows = by_turn[ends[i - REACH] : ends[i - REACH + 1]]
        b, p, distance = block[rows], column["p"][rows], column["distance"][rows]
        root = (distance == 0) | (p < distance)
        parent = np.where(root, DELIVERED, status[b, i - distance])
        start = np.where(root, STEP * p, np.maximum(STEP * p, last[b, i - distance]))
        left = np.clip(STEP * p + column["repair"][rows] - start, 0, LONGEST)
        tries = table[left, column["mask"][rows]]
        own = np.where(parent == DELIVERED, np.where(tries > 0, DELIVERED, DEAD), np.where(parent == OPEN, OPEN, BLOCKED))
        attempts[rows] = np.where(parent == DELIVERED, np.where(tries > 0, tries, ATTEMPTS), 0)
        first[rows], status[b, i] = start, own
        last[b, i] = start + OFFSETS[np.maximum(attempts[rows], 1) - 1]
    status, last = status[block, at], last[block, at]
    tried = (status == DELIVERED) | (status == DEAD)
    new = {"status": pa.array(status), "attempts": pa.array(attempts), "first_at": pa.array(first, mask=~tried), "last_at": pa.array(last, mask=~tried)}
    names = batch.schema.names
    return pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in names], names=names).filter(pa.array(~given))


def replay(turns: DataFrame) -> DataFrame:
    """numbered(turns) with status (a code), attempts, first_at and last_at."""
    rows = numbered(turns).withColumn("blk", F.floor(F.col("p") / BLOCK).cast("long"))
    for name, kind in (x.split() for x in _COLUMNS.split(", ")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("start", "long"), ("g", "long")])

    def passed(df: DataFrame) -> DataFrame:
        df = df.withColumn("start", F.col("blk") * BLOCK).withColumn("g", F.xxhash64("key", "blk")).repartition("key", "blk").sortWithinPartitions("key", "blk", "p")
        return written(df.mapInArrow(_replay, kinds).drop("start", "g"), "release-replay")

    now = passed(rows)
    done, open_ = now.filter(F.col("status") != OPEN), now.filter(F.col("status") == OPEN)
    while not open_.isEmpty():
        # the last turns of the block before, as far as they are known; those that aren't leave their children open once more
        tails = done.filter(F.col("p") % BLOCK >= BLOCK - REACH).withColumn("blk", F.col("blk") + 1)
        tails = tails.join(open_.select("key", "blk").distinct().hint("merge"), ["key", "blk"], "left_semi").select(*now.columns)
        again = passed(open_.select(*now.columns).unionByName(tails))
        done, open_ = done.unionByName(again.filter(F.col("status") != OPEN)), again.filter(F.col("status") == OPEN)
    return done


def _wrapped(total: Column) -> Column:
    """A whole decimal modulo 2^64, as a signed long."""
    half, full = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return (F.pmod(total + half, full) - half).cast("long")


def released(rows: DataFrame) -> DataFrame:
    """Delivered rows of ``replay`` with release_no and state; a range holds about BLOCK releases."""
    rows = rows.withColumn("range", F.floor(F.col("last_at") / (STEP * BLOCK)).cast("long"))
    order = Window.partitionBy("key", "range").orderBy("last_at", "turn", "p")
    rows = rows.withColumn("place", F.row_number().over(order).cast("long"))
    big = lambda c: c.cast("decimal(38,0)")
    weighted = F.col("place").cast("decimal(12,0)") * F.col("crc").cast("decimal(10,0)")
    rows = rows.withColumn("crcs", F.sum(F.col("crc")).over(order)).withColumn("weighted", big(F.sum(weighted).over(order)))
    rows = written(rows, "release-places")
    ranges = written(rows.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("crc").alias("c"), big(F.sum(weighted)).alias("w")), "release-sums")
    counted = sums_before(ranges, "range", {"n": "done"}).withColumn("s", big(F.col("done").cast("decimal(18,0)") * F.col("c").cast("decimal(19,0)") + F.col("w")))
    offsets = sums_before(written(counted, "release-offsets"), "range", {"s": "before"}).select("key", "range", "done", big(F.col("before")).alias("before"))
    state = F.col("before") + F.col("done").cast("decimal(18,0)") * F.col("crcs").cast("decimal(19,0)") + F.col("weighted")
    return rows.join(offsets.hint("merge"), ["key", "range"]).withColumn("release_no", (F.col("done") + F.col("place")).cast("long")).withColumn("state", _wrapped(big(state)))


def report(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, status, attempts, first_at, last_at, release_no, state."""
    rows = replay(turns)
    columns = ["conv_id", "turn", "status", "attempts", "first_at", "last_at"]
    out = released(rows.filter(F.col("status") == DELIVERED)).select(*columns, "release_no", "state")
    none = F.lit(None).cast("long")
    out = out.unionByName(rows.filter(F.col("status") != DELIVERED).select(*columns, none.alias("release_no"), none.alias("state")))
    named = F.when(F.col("status") == DELIVERED, "delivered").when(F.col("status") == DEAD, "dead").otherwise("blocked")
    return out.withColumn("status", named)
