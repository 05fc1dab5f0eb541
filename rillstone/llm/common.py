"""What the operators of this subpackage share: tables, scratch tables and distributed ranks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.membership import free_names, with_membership
from ..sources.scratch import discard, scratch_dir, written
from ..sources.tables import table

__all__ = ["BUCKET_ROWS", "WORD", "buckets_for", "discard", "free_names", "hot_join", "lean", "running_sum", "scratch_dir", "table", "unit_hash", "with_membership", "written"]

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that one bucket of a distributed rank holds on average, at most.
BUCKET_ROWS = 10_000


def unit_hash(*cols: Column) -> Column:
    """A whole number in [0, 2^32) from the first 32 bits of an MD5; the same in every engine."""
    text = F.concat_ws(",", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def buckets_for(rows: int, most: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // most))


def running_sum(df: DataFrame, groups: list[str], hashed: str, order: list[str], value: str, out: str, buckets: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before each row of its group, ordered by ``hashed`` and ``order``.

    No group meets in one task: a group is cut into ranges of ``hashed`` (0 to 2^32),
    range totals give offsets, and only a range is sorted at once. df is read twice, so
    it should be a table. ``groups`` must not hold nulls.
    """
    at = F.floor(F.col(hashed) * buckets / float(2**32)).cast("int")
    df = df.withColumn("_bucket", at)
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_sum"))
    offsets = totals.select(*groups, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(hashed, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, [*groups, "_bucket"])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_bucket", "_offset")
    )


#: A key with over this share of all rows is hot; at most 1 / HOT such keys exist.
HOT = 1 / 1000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join with ``right``, one row a key, whose column ``rows`` says how many of the ``total`` rows of left have the key.

    Hot keys meet by broadcast (at most 1 / HOT rows), so that none of them fills one task; the others
    are shuffled. Both sides are read twice, so they should be tables; keys are not null.
    """
    least = max(1000, int(total * HOT))
    hot, light = right.filter(F.col(rows) > least), right.filter(F.col(rows) <= least)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(light, on)
    return left.join(F.broadcast(hot), on).unionByName(cold)


#: Rows that a Python worker handles at once.
SLICE = 512


def lean(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what a worker makes of one stays small; freed memory goes back at the end of the task."""
    import ctypes

    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        del batch
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
