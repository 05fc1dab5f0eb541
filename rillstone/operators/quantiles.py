"""Exact quantiles of a whole table: histogram passes that narrow down to the wanted ranks.

A built-in exact percentile holds every distinct value in one buffer. Here each pass counts values in equal slices of the brackets that hold
a wanted rank, with map-side sums, and keeps the slice with the rank; its least and largest value are the next bracket. Slices are monotone in the value
whatever the rounding, the least and the largest value of a bracket never share one, and a slice of a single value is the answer. The driver sees
counts of slices only, a bounded number a rank, and the values are read once a pass.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written

#: Slices of a bracket.
SLICES = 4096


def _slice(x: Column, low: float, high: float, slices: int) -> Column:
    """The place of x in [low, high], from 0 to slices - 1; halves keep the width of the widest bracket finite."""
    share = (x / 2 - low / 2) / (high / 2 - low / 2) if high / 2 - low / 2 > 0 else F.when(x > low, 1.0).otherwise(0.0)
    return F.least(F.greatest(F.floor(share * slices), F.lit(0)), F.lit(slices - 1)).cast("int")


def order_statistics(values: DataFrame, column: str, ranks: list[int], slices: int = SLICES) -> dict[int, float]:
    """The values at some ranks, from 0. Null doesn't count; NaN is above all else. Memory is bounded by the ranks and slices, not by the values."""
    if not ranks:
        return {}
    x = F.col(column)
    nan, finite = F.isnan(x), ~F.isnan(x) & (F.abs(x) != math.inf)
    total = values.filter(x.isNotNull()).agg(F.count_if(x == -math.inf), F.count_if(finite), F.count_if(x == math.inf), F.count_if(nan), F.min(F.when(finite, x)), F.max(F.when(finite, x))).first()
    least, inner, most, no_number, low, high = total
    if any(r < 0 or r >= least + inner + most + no_number for r in ranks):
        raise ValueError(f"a rank is outside of the table: {ranks}")
    found: dict[int, float] = {}
    open_: dict[tuple[float, float], list[tuple[int, int]]] = {}  # bracket: (rank, rank within it)
    for r in set(ranks):
        if r < least:
            found[r] = -math.inf
        elif r >= least + inner:
            found[r] = math.inf if r < least + inner + most else math.nan
        elif low == high:
            found[r] = low
        else:
            open_.setdefault((low, high), []).append((r, r - least))
    while open_:
        brackets = list(open_)
        which, place = F.lit(None).cast("int"), F.lit(None).cast("int")
        for k, (a, b) in enumerate(brackets):  # brackets are slices of one table: they don't overlap
            inside = x.between(a, b)
            which, place = F.when(inside, k).otherwise(which), F.when(inside, _slice(x, a, b, slices)).otherwise(place)
        rows = values.filter(reduce(Column.__or__, [x.between(a, b) for a, b in brackets])).select(x, which.alias("which"), place.alias("place"))
        counts = sorted(map(tuple, rows.groupBy("which", "place").agg(F.min(column), F.max(column), F.count(F.lit(1))).collect()))
        ahead: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for k, bracket in enumerate(brackets):
            wanted, before = sorted(open_[bracket], key=lambda w: w[1]), 0
            for _, _, a, b, n in (c for c in counts if c[0] == k):
                while wanted and wanted[0][1] < before + n:
                    rank, within = wanted.pop(0)
                    if a == b:
                        found[rank] = a
                    else:
                        ahead.setdefault((a, b), []).append((rank, within - before))
                before += n
        open_ = ahead
    return found


def exact_quantiles(df: DataFrame, value: str | Column, shares: list[float]) -> list[float | None]:
    """Quantiles by linear interpolation, as an exact percentile gives them; None without values.

    The values are written once to the scratch folder, and removed again, so that a plan behind them runs once.
    """
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError(f"shares are between 0 and 1: {shares}")
    column = (F.col(value) if isinstance(value, str) else value).cast("double").alias("x")
    kept = written(df.select(column).filter("x IS NOT NULL"), "quantiles")
    n = kept.count()
    places = [(n - 1) * q for q in shares]
    got = order_statistics(kept, "x", sorted({r for p in places for r in (math.floor(p), math.ceil(p))})) if n else {}
    discard(kept)
    return [_between(got[math.floor(p)], got[math.ceil(p)], p - math.floor(p)) if n else None for p in places]


def _between(low: float, high: float, share: float) -> float:
    return low if low == high or share == 0 else (1 - share) * low + share * high
