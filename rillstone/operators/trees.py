"""Prefix trees of candidate lines in long form: a node is its prefix, so no graph library is needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..sources.scratch import written


def visits(df: DataFrame, tree: str, line: str, moves: str) -> DataFrame:
    """One row per visit: tree, prefix, depth, line, and whether it is the node's first visit (lines in order)."""
    at = F.sequence(F.lit(1), F.size(moves))
    v = df.filter(F.size(moves) > 0).select(tree, line, F.explode(F.transform(at, lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(moves, F.lit(1), i), " ").alias("prefix")))).alias("x"))
    v = v.select(tree, line, "x.depth", "x.prefix")
    first = F.min(line).over(Window.partitionBy(tree, "prefix"))
    return v.withColumn("is_first", F.col(line) == first)


def shape(v: DataFrame, tree: str) -> DataFrame:
    """Per tree: root candidates, nodes, leaves, depth, visits and the share of visits to seen nodes."""
    nodes = v.groupBy(tree, "prefix").agg(F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n"))
    parents = nodes.filter("depth > 1").select(tree, F.expr("substring_index(prefix, ' ', depth - 1)").alias("prefix")).distinct().withColumn("inner_node", F.lit(1))
    nodes = nodes.join(parents, [tree, "prefix"], "left")
    return nodes.groupBy(tree).agg(
        F.count_if(F.col("depth") == 1).alias("root_candidates"), F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("inner_node").isNull()).alias("leaves"),
        F.max("depth").alias("max_depth"), F.sum("n").cast("long").alias("visits"), ((F.sum("n") - F.count(F.lit(1))) / F.sum("n")).alias("revisit_rate"),
    )


def branching(nodes: Column, depth: Column) -> Column:
    return F.pow(nodes.cast("double"), 1.0 / depth)


def kendall_tau(ranks: list[int]) -> float:
    """Kendall's tau between 0, 1, 2, ... and distinct ranks, by counting inversions in merges; 1.0 with fewer than two."""
    n = len(ranks)
    if n < 2:
        return 1.0
    inversions, width, r = 0, 1, list(ranks)
    while width < n:
        for at in range(0, n, 2 * width):
            left, right, out = r[at : at + width], r[at + width : at + 2 * width], []
            i = j = 0
            while i < len(left) and j < len(right):
                if left[i] <= right[j]:
                    out.append(left[i])
                    i += 1
                else:
                    out.append(right[j])
                    j += 1
                    inversions += len(left) - i
            r[at : at + 2 * width] = out + left[i:] + right[j:]
        width *= 2
    return 1.0 - 4.0 * inversions / (n * (n - 1))


def preorder_ranks(prefixes: list[str]) -> list[int]:
    """For nodes in the order of their first visits, their places in depth-first preorder, children as first visited. A parent is visited before its children."""
    at = {p: k for k, p in enumerate(prefixes)}
    chains = []
    for p in prefixes:
        words = p.split(" ")
        chains.append([at.get(" ".join(words[:k]), -1) for k in range(1, len(words) + 1)])
    order = sorted(range(len(prefixes)), key=chains.__getitem__)
    ranks = [0] * len(prefixes)
    for place, k in enumerate(order):
        ranks[k] = place
    return ranks


@F.pandas_udf(DoubleType())
def _consistency(visits: pd.Series) -> pd.Series:
    return visits.map(lambda v: kendall_tau(preorder_ranks(list(v)))).astype("float64")


def dfs_consistency(v: DataFrame, tree: str, line: str) -> DataFrame:
    """Tau between the order of first visits and depth-first preorder, per tree; a tree fits one row, merges count its inversions."""
    first = v.filter("is_first").groupBy(tree, "prefix").agg(F.min(F.struct(line, "depth")).alias("visit"))
    seq = first.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("visit", "prefix"))).alias("_seq"))
    return seq.select(tree, _consistency(F.col("_seq.prefix")).alias("tau"))


def row_metrics(df: DataFrame, key: str, output: str) -> DataFrame:
    """One row per output: its tree's shape and consistency, and the length of its reasoning; without lines, zeros and full consistency."""
    from ..functions import text as X

    lines = df.select(key, F.posexplode(X.lines_of(F.col(output))).alias("line", "moves"))
    v = written(visits(lines, key, "line", "moves"), "row-visits")
    nodes, depth = F.coalesce("nodes", F.lit(0)), F.coalesce("max_depth", F.lit(0))
    out = df.select(key, F.length(X.reasoning(F.col(output))).alias("n_chars")).join(shape(v, key), key, "left").join(dfs_consistency(v, key, "line"), key, "left")
    return out.select(
        key, F.coalesce("root_candidates", F.lit(0)).alias("candidate_count"), nodes.alias("num_nodes"), depth.alias("max_depth"), F.when(depth > 0, branching(nodes, depth)).otherwise(0.0).alias("branching"),
        F.when(depth > 0, F.col("leaves") / depth).otherwise(0.0).alias("leaves_per_depth"), F.coalesce("visits", F.lit(0)).alias("visits"), F.coalesce("revisit_rate", F.lit(0.0)).alias("revisit_rate"),
        F.coalesce("tau", F.lit(1.0)).alias("consistency"), "n_chars",
    )


def minimax_level(df: DataFrame, parent: list[str], value: str, maximise: bool) -> DataFrame:
    """One level up: the best (or worst) child value per parent; a missing leaf counts 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return df.groupBy(*parent).agg((F.max(v) if maximise else F.min(v)).alias(value))


def minimax(nodes: DataFrame, tree: str, depth: int, value: str = "value") -> DataFrame:
    """Root values of prefix-form trees: level by level, maximum where the root's side moves. Leaves carry values; depth bounds the levels."""
    out = nodes.select(tree, "prefix", "depth", value)
    for level in range(depth, 1, -1):
        here = out.filter(F.col("depth") == level).withColumn("prefix", F.expr(f"substring_index(prefix, ' ', {level - 1})"))
        up = minimax_level(here, [tree, "prefix"], value, maximise=level % 2 == 1).withColumnRenamed(value, "_child")
        out = out.filter(F.col("depth") < level).join(up, [tree, "prefix"], "left").withColumn(value, F.when(F.col("depth") == level - 1, F.coalesce("_child", value)).otherwise(F.col(value))).drop("_child")
    return minimax_level(out, [tree], value, maximise=True)


def linearise(v: DataFrame, tree: str, line: str) -> DataFrame:
    """Lines in order joined by the separator, new nodes only after the shared prefix."""
    rows = v.groupBy(tree, line).agg(F.max(F.struct("depth", "prefix"))["prefix"].alias("text"))
    seq = rows.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct(line, "text"))).alias("s"))
    return seq.select(tree, F.concat(F.lit("<T> "), F.array_join(F.col("s.text"), " <sep> "), F.lit(" </T>")).alias("text"))
