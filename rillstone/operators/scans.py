"""Recurrences along a sequence of any length, as scans over blocks.

y(i) = value(i) + open(i + 1) * (gamma * y(i + 1) + ahead * follow(i + 1)), from the end of a sequence to its start. A block of
consecutive rows maps what comes in from its right to the y of its first row by an affine map, y = a + p * x, and such maps
compose. So rows are dealt by (sequence, block), each block is summed up by itself, the maps of blocks are composed in ranges, and of ranges
of ranges, what comes in flows back down, and each block adds its share. No sequence meets in one task, and powers of gamma
are taken within a block only, so they neither vanish nor overflow, however long the sequence is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Rows of a block at most, the size of a power of gamma within it, and maps that are composed at once.
LENGTH, DIGITS, FAN = 1024, 200, 64
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def block_length(gamma: float) -> int:
    if gamma == 0 or abs(gamma) == 1:
        return LENGTH
    return max(1, min(LENGTH, int(DIGITS / abs(math.log10(abs(gamma))))))


def reverse_scan(rows: DataFrame, key: str, order: str, value: Column, gamma: float, out: str, follow: Column | None = None, ahead: float = 0.0, open_: Column | None = None) -> DataFrame:
    """rows with ``out``, the recurrence above within ``key`` by ``order``; ``open_`` is a boolean, true where missing.

    Blocks are ranges of ``order`` if it is a whole number (gaps are fine), else of the place in the sequence, for which the sequence is
    sorted in one task. Rows that tie in order should be told apart by the caller.
    """
    length, gamma, ahead = block_length(gamma), float(gamma), float(ahead)
    rows = rows.withColumn("_value", value.cast("double")).withColumn("_follow", F.lit(0.0) if follow is None else F.coalesce(follow.cast("double"), F.lit(0.0)))
    rows = rows.withColumn("_open", F.lit(True) if open_ is None else F.coalesce(open_, F.lit(False)))
    at = F.col(order) if dict(rows.dtypes)[order] in _WHOLE else F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    rows = rows.withColumn("_at", at.cast("long"))
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    low, high = ((x or 0) // length for x in (low, high))
    rows = rows.withColumn("_block", F.expr(f"_at div {length} - if(_at < 0 and _at % {length} <> 0, 1, 0)") - low)  # from 0
    group = [key] if low == high else [key, "_block"]

    w = Window.partitionBy(*group).orderBy(order)
    rows = rows.withColumn("_place", F.row_number().over(w) - 1)
    chain = []
    if open_ is not None:  # a closed row starts a chain to its left
        rows, chain = rows.withColumn("_chain", F.sum((~F.col("_open")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))), ["_chain"]
    if ahead:
        rows = rows.withColumn("_value", F.col("_value") + ahead * F.coalesce(F.lead(F.when(F.col("_open"), F.col("_follow"))).over(w), F.lit(0.0)))
    back = Window.partitionBy(*group, *chain).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda n: F.pow(F.lit(gamma), n) if gamma not in (0, 1) else F.when(n == 0, 1.0).otherwise(gamma)
    if gamma == 0:
        rows = rows.withColumn(out, F.col("_value"))
    else:
        rows = rows.withColumn(out, F.sum(F.col("_value") * power(F.col("_place"))).over(back) / power(F.col("_place")))
    helpers = ["_value", "_follow", "_open", "_at", "_block", "_place", *chain]
    if low == high:
        return rows.drop(*helpers)

    first = lambda c: F.min_by(c, "_place")
    last = F.max("_chain") if chain else F.lit(0)
    maps = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), first(out).alias("a"), first("_follow").alias("v"), first("_open").alias("o"), last.alias("_last"), (F.min("_chain") if chain else F.lit(0)).alias("_first"))
    maps = maps.withColumn("p", F.when(F.col("_first") == F.col("_last"), power(F.col("_n") - 1)).otherwise(0.0))
    maps = written(maps, "scan-maps")  # a row a block, read at each level
    inflow = _inflows(maps.select(key, "_block", "a", "p", "v", "o"), key, gamma, ahead, high - low)
    met = rows.join(maps.select(*group, "_n", "_last").join(inflow, group).hint("merge"), group)  # rows are dealt by group already
    share = power(F.col("_n") - 1 - F.col("_place")) * F.col("_x")
    if chain:
        share = F.when(F.col("_chain") == F.col("_last"), share).otherwise(0.0)
    return met.withColumn(out, F.col(out) + share).drop(*helpers, "_n", "_last", "_x")


def _inflows(maps: DataFrame, key: str, gamma: float, ahead: float, last: int) -> DataFrame:
    """(key, _block, _x): what comes in from the right of each block, 0 to ``last``; maps: key, _block, a, p, v and o of its first row."""
    member = F.struct("_block", "a", "p", "v", "o")
    ranges = maps.groupBy(key, F.floor(F.col("_block") / FAN).alias("_range")).agg(F.reverse(F.array_sort(F.collect_list(member))).alias("_maps"))
    goes_on = lambda y, b: F.when(b["o"], gamma * y + ahead * b["v"]).otherwise(0.0)
    last //= FAN
    if not last:
        ranges = ranges.withColumn("_end", F.lit(0.0))
    else:
        none = F.struct(F.lit(0.0).alias("a"), F.lit(1.0).alias("p"), F.lit(0.0).alias("v"), F.lit(True).alias("o"), F.lit(True).alias("first"))

        def compose(acc: Column, b: Column) -> Column:
            # the maps to the right make x = c + d * end of what comes into b
            c = F.when(acc["first"], F.lit(0.0)).otherwise(goes_on(acc["a"], acc))
            d = F.when(acc["first"], F.lit(1.0)).otherwise(F.when(acc["o"], gamma * acc["p"]).otherwise(0.0))
            return F.struct((b["a"] + b["p"] * c).alias("a"), (b["p"] * d).alias("p"), b["v"].alias("v"), b["o"].alias("o"), F.lit(False).alias("first"))

        whole = ranges.select(key, F.col("_range").alias("_block"), F.aggregate("_maps", none, compose).alias("_m")).select(key, "_block", *[F.col(f"_m.{c}").alias(c) for c in "apvo"])
        above = _inflows(whole, key, gamma, ahead, last).select(key, F.col("_block").alias("_range"), F.col("_x").alias("_end"))
        ranges = ranges.join(above, [key, "_range"])
    start = F.struct(F.col("_end").alias("x"), F.array().cast("array<struct<_block:bigint,_x:double>>").alias("all"))

    def pass_on(acc: Column, b: Column) -> Column:
        every = F.concat(acc["all"], F.array(F.struct(b["_block"].alias("_block"), acc["x"].alias("_x"))))
        return F.struct(goes_on(b["a"] + b["p"] * acc["x"], b).alias("x"), every.alias("all"))

    return ranges.select(key, F.explode(F.aggregate("_maps", start, pass_on)["all"]).alias("_b")).select(key, "_b._block", "_b._x")
