"""Prefix trees written out as text: depth first or breadth first, with directions, separators, level marks and results.

A tree is in long form, one row a node: its prefix (moves joined by blanks), depth, an order among
its siblings, and for leaves a label. The path of sibling orders from the root to a node sorts a tree depth first,
and after the depth it sorts it breadth first; so no task walks a tree. Only the
text of one tree at a time is in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Markup of traversals.
DOWN, UP, LEVEL, SEP = "<down>", "<up>", "<level>", "<sep>"


def nodes_of(v: DataFrame, tree: str, line: str) -> DataFrame:
    """The nodes of trees.visits; siblings are ordered by the line that came to them first."""
    return v.groupBy(tree, "prefix").agg(F.min("depth").alias("depth"), F.min(line).alias("order"))


def by_value(nodes: DataFrame, tree: str, value: str, order: str = "order") -> DataFrame:
    """Siblings from the highest value to the lowest, a missing value counting 0, ties in the order they had."""
    parent = F.expr("substring_index(prefix, ' ', depth - 1)")
    rank = F.row_number().over(Window.partitionBy(tree, "depth", parent).orderBy(F.coalesce(value, F.lit(0.0)).desc(), order))
    return nodes.withColumn("order", rank)


def with_paths(nodes: DataFrame, tree: str, order: str = "order") -> DataFrame:
    """Adds ``path``, the sibling orders from the root, and ``leaf``. A join of each node to its ancestors: rows grow with the nodes times their depth."""
    levels = nodes.select(tree, "prefix", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("_level"))
    levels = levels.withColumn("_at", F.expr("substring_index(prefix, ' ', _level)"))
    known = nodes.select(tree, F.col("prefix").alias("_at"), F.col(order).alias("_order"))
    steps = levels.join(known, [tree, "_at"]).groupBy(tree, "prefix").agg(F.array_sort(F.collect_list(F.struct("_level", "_order"))).alias("_steps"))
    parents = nodes.filter("depth > 1").select(tree, F.expr("substring_index(prefix, ' ', depth - 1)").alias("prefix")).distinct().withColumn("_inner", F.lit(True))
    out = nodes.join(steps, [tree, "prefix"]).join(parents, [tree, "prefix"], "left")
    return out.withColumn("path", F.col("_steps._order")).withColumn("leaf", F.col("_inner").isNull()).drop("_steps", "_inner")


def result(label: Column) -> Column:
    """A leaf's label as +1, 0 or -1 inside its tag; a missing label counts 0."""
    label = F.coalesce(label, F.lit(0))
    return F.concat(F.lit("<result>"), F.when(label > 0, "+1").when(label < 0, "-1").otherwise("0"), F.lit("</result>"))


def traversal(
    nodes: DataFrame, tree: str, order: str = "order", label: str | None = None, breadth: bool = False,
    directions: bool = False, separators: bool = False, levels: bool = False, layers: bool = False,
) -> DataFrame:
    """(tree, text): the moves of each tree in depth-first or breadth-first order.

    label: results follow leaves. directions: down before a move and up on the way back (depth first). separators: between the subtrees of the
    root's children; breadth first then goes through one such subtree after the other. levels: a mark before
    each level (breadth first). layers: the depth after each move.
    """
    if directions and breadth or levels and not breadth:
        raise ValueError("directions are for depth first, level marks for breadth first")
    apart = F.element_at("path", 1) if breadth and separators else F.lit(0)
    row = F.struct(apart.alias("root"), (F.col("depth") if breadth else F.lit(0)).alias("level"), "path", "depth", F.expr("substring_index(prefix, ' ', -1)").alias("move"), "leaf", (F.col(label) if label else F.lit(None).cast("int")).alias("label"))
    seq = with_paths(nodes, tree, order).groupBy(tree).agg(F.array_sort(F.collect_list(row)).alias("_seq"))
    none = F.array().cast("array<string>")

    def tokens(x: Column, i: Column) -> Column:
        before = F.get("_seq", i - 1)
        parts = []
        if directions:
            parts.append(F.when(i > 0, F.array_repeat(F.lit(UP), before["depth"] - x["depth"] + 1)).otherwise(none))
        new_root = (i > 0) & (x["root"] != before["root"] if breadth else x["depth"] == 1)
        if separators:
            parts.append(F.when(new_root, F.array(F.lit(SEP))).otherwise(none))
        if levels:
            parts.append(F.when((i == 0) | (x["depth"] != before["depth"]) | (new_root if separators else F.lit(False)), F.array(F.lit(LEVEL))).otherwise(none))
        if directions:
            parts.append(F.array(F.lit(DOWN)))
        parts.append(F.array(x["move"]))
        if layers:
            parts.append(F.array(F.concat(F.lit("[l"), x["depth"].cast("string"), F.lit("]"))))
        if label:
            parts.append(F.when(x["leaf"], F.array(result(x["label"]))).otherwise(none))
        return F.concat(*parts)

    words = F.flatten(F.transform("_seq", tokens))
    if directions:  # the way back from the last node
        words = F.concat(words, F.array_repeat(F.lit(UP), F.element_at("_seq", -1)["depth"]))
    return seq.select(tree, F.array_join(words, " ").alias("text"))


def trace(text: Column, move: Column, context: Column | None = None) -> Column:
    """A traversal as a reasoning trace with its answer, after the context if there is one; empty without a traversal or a move."""
    body = F.concat(F.lit("<T> "), text, F.lit(" </T> "), move)
    whole = F.trim(F.concat_ws(" ", F.nullif(context, F.lit("")), body)) if context is not None else body
    return F.when((F.coalesce(text, F.lit("")) != "") & (F.coalesce(move, F.lit("")) != ""), whole).otherwise("")


def interleaved(moves: Column, most: int = 5, call: str = "<call_env>") -> Column:
    """Own moves and replies in turn: a call follows each own move. The first move of the list was already made and is left out."""
    left = F.slice(moves, 2, most)
    return F.array_join(F.flatten(F.transform(left, lambda m, i: F.when(i % 2 == 0, F.array(m, F.lit(call))).otherwise(F.array(m)))), " ")
