"""Sequential greedy filling, cut exactly, without a sequential pass.

A shard is filled in order until the next row would pass the cap. So the shard that starts at a row ends before the first row whose end
lies beyond a target: the row's start plus the cap (or its own end, if it is larger than the cap). Starts
and ends are prefix sums, and the target tells all there is to know about what came before. So

* a file is cut into runs of WIDE caps of bytes at most, each in a task of its own. From any of its rows a run knows the target with which its chain of shards leaves, and how many
  shards it opens until then: the next opening row is a search in sorted ends, and jumps are doubled;
* each target with which some chain leaves a run becomes a node, and the next run says where it leads. The node graph is followed
  from the file's first row by doubling jumps once more, in rounds that grow with the logarithm of the runs;
* the one target that really enters each run then names its rows' shards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import discard, written

#: Caps of bytes in a run, at most, and counts that a window holds.
WIDE, FAN = 16, 256


def sums_before(counts: DataFrame, keys: list[str], index: str, value: str, out: str) -> DataFrame:
    """counts (a table; one row per keys and whole index from 0) with the sum of ``value`` over smaller indexes as ``out``, in windows of FAN rows at most."""
    most = counts.agg(F.max(index)).first()[0] or 0
    before = lambda *by: F.coalesce(F.sum(value).over(Window.partitionBy(*keys, *by).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if most < FAN:
        return counts.withColumn(out, before())
    wide = counts.withColumn("_wide", F.expr(f"`{index}` div {FAN}"))
    upper = written(wide.groupBy(*keys, "_wide").agg(F.sum(value).alias(value)), "shard-ranges")
    upper = sums_before(upper, keys, "_wide", value, "_upper").select(*keys, "_wide", "_upper")
    return wide.join(upper, [*keys, "_wide"]).withColumn(out, F.col("_upper") + before("_wide")).drop("_wide", "_upper")


def prefix_sums(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """rows with the sum of ``value`` over the rows before, within ``keys`` by ``order``; no key meets in one task. rows is read once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(rows.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()), "shard-rows")
    counts = written(rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum")), "shard-sums")
    offsets = sums_before(counts, keys, "_part", "_sum", "_offset").select(*keys, "_part", "_offset")
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, [*keys, "_part"]).withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_offset")


def _chains(start: np.ndarray, end: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of a run, as the first of a shard: the place of the next shard's first row (the number of rows, if it isn't in the run), the last opening row of its chain, and how many the chain opens."""
    n = len(start)
    follows = np.searchsorted(end, np.maximum(start + cap, end), "right")
    last, opened, jump = np.arange(n + 1), np.append(np.ones(n, dtype=np.int64), 0), np.append(follows, n)
    while (jump[:n] < n).any():
        inside = jump < n
        last = np.where(inside, last[np.minimum(jump, n)], last)
        opened = opened + np.where(inside, opened[jump], 0)
        jump = jump[jump]
    return follows, last[:n], opened[:n]


def _sorted(run: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    run = run.sort_values("_start", kind="stable")
    start = run["_start"].to_numpy(dtype=np.int64)
    return run, start, start + run["_size"].to_numpy(dtype=np.int64)


def _target(start: np.ndarray, end: np.ndarray, cap: int, width: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where chains that leave after opening these rows go: the target and the run that has the first row beyond it."""
    target = np.maximum(start + cap, end)
    return target, np.where(target == end, np.maximum(end // width, run + 1), run + 1)  # where the file ends, a run without rows


def _leaving(run: pd.DataFrame, cap: int, width: int, file: str) -> pd.DataFrame:
    """The distinct targets of a run's chains."""
    _, start, end = _sorted(run)
    _, last, _ = _chains(start, end, cap)
    places = np.unique(last)
    target, to = _target(start[places], end[places], cap, width, int(run["_run"].iloc[0]))
    return pd.DataFrame({file: [run[file].iloc[0]] * len(places), "_run": to, "_target": target})


def _passing(key: tuple, run: pd.DataFrame, nodes: pd.DataFrame, cap: int, width: int, file: str) -> pd.DataFrame:
    """Where each node of a run leads: the next node, and how many shards are opened on the way; nothing, where the file ends."""
    empty = pd.DataFrame({file: pd.Series([], dtype=object), "_run": np.zeros(0, dtype=np.int64), "_target": np.zeros(0, dtype=np.int64), "_to_run": np.zeros(0, dtype=np.int64), "_to": np.zeros(0, dtype=np.int64), "_opened": np.zeros(0, dtype=np.int64)})
    if not len(run) or not len(nodes):
        return empty
    _, start, end = _sorted(run)
    _, last, opened = _chains(start, end, cap)
    given = nodes["_target"].to_numpy(dtype=np.int64)
    first = np.searchsorted(end, given, "right")
    given, first = given[first < len(end)], first[first < len(end)]
    target, to = _target(start[last[first]], end[last[first]], cap, width, int(key[1]))
    return pd.DataFrame({file: [key[0]] * len(first), "_run": int(key[1]), "_target": given, "_to_run": to, "_to": target, "_opened": opened[first]})


def _naming(run: pd.DataFrame, cap: int, file: str, order: str) -> pd.DataFrame:
    run, start, end = _sorted(run)
    follows, _, _ = _chains(start, end, cap)
    at, opens = int(np.searchsorted(end, run["_target"].iloc[0], "right")), np.zeros(len(run), dtype=np.int64)
    while at < len(run):
        opens[at] = 1
        at = int(follows[at])
    return pd.DataFrame({file: run[file], order: run[order], "shard": run["_before"].iloc[0] - 1 + np.cumsum(opens)})


def greedy_shards(df: DataFrame, file: str, order: str, size: Column, cap: int) -> DataFrame:
    """(file, order, shard): a file's rows in order; a new shard opens before a row that would pass the cap, so only a row larger than the cap does.

    Sizes are at least 1; file and order aren't null, and order tells a file's rows apart.
    """
    kinds = dict(df.dtypes)
    rows = prefix_sums(df.select(file, order, size.cast("long").alias("_size")), [file], order, "_size", "_start")
    rows = written(rows, "shard-prefix")
    total = rows.agg(F.max(F.col("_start") + F.col("_size"))).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = cap * max(1, min(WIDE, total // (cap * parts)))
    rows = rows.withColumn("_run", F.expr(f"_start div {width}"))

    first = rows.groupBy(file).agg(F.min("_run").alias("_run")).withColumn("_target", F.lit(-1).cast("long"))
    leaving = rows.groupBy(file, "_run").applyInPandas(lambda run: _leaving(run, cap, width, file), f"`{file}` {kinds[file]}, _run long, _target long")
    nodes = written(leaving.distinct().unionByName(first.select(file, "_run", "_target")), "shard-nodes")
    passing = lambda key, run, node: _passing(key, run, node, cap, width, file)
    jump = rows.groupBy(file, "_run").cogroup(nodes.groupBy(file, "_run")).applyInPandas(passing, f"`{file}` {kinds[file]}, _run long, _target long, _to_run long, _to long, _opened long")
    jumps, node = [written(jump, "shard-jumps")], [file, "_run", "_target"]
    while True:  # jumps of twice the length, until none is left
        last = jumps[-1]
        further = last.select(file, F.col("_run").alias("_to_run"), F.col("_target").alias("_to"), F.col("_to_run").alias("_far_run"), F.col("_to").alias("_far"), F.col("_opened").alias("_more"))
        twice = last.join(further, [file, "_to_run", "_to"]).select(*node, F.col("_far_run").alias("_to_run"), F.col("_far").alias("_to"), (F.col("_opened") + F.col("_more")).alias("_opened"))
        twice = written(twice, "shard-jumps")
        if twice.isEmpty():
            discard(twice)
            break
        jumps.append(twice)
    met = first.select(*node, F.lit(0).cast("long").alias("_before"))
    for jump in reversed(jumps):
        ahead = met.join(jump, node).select(file, F.col("_to_run").alias("_run"), F.col("_to").alias("_target"), (F.col("_before") + F.col("_opened")).alias("_before"))
        met = written(met.unionByName(ahead), "shard-entries")
    return rows.join(met, [file, "_run"]).groupBy(file, "_run").applyInPandas(lambda run: _naming(run, cap, file, order), f"`{file}` {kinds[file]}, `{order}` {kinds[order]}, shard long")


def free_index(shard: Column, taken: list[int], first: int = 0) -> Column:
    """The shard-th index from ``first`` on that isn't taken, so that no shard that exists is overwritten."""
    taken = sorted(t for t in set(taken) if t >= first)
    start = (shard + first).cast("long")
    return F.aggregate(F.array(*[F.lit(t).cast("long") for t in taken]), start, lambda at, t: F.when(t <= at, at + 1).otherwise(at)) if taken else start
