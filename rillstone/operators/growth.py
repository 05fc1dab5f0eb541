"""Growing search trees level by level from tables of engine scores, labelling and writing them.

An engine's scores are an input table: one row per (position, move) with the child position and the move's value from the side to move
at a working and at a reference depth. A frontier of nodes is joined to it once a level, so a tree costs as many jobs as it is deep,
however many trees grow at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def forced_values(scores: DataFrame, position: str, child: str, white: str, cp: str) -> DataFrame:
    """Scores of children, given for white, from the side that moves in the position."""
    return scores.withColumn("value", F.when(F.col(white), F.col(cp)).otherwise(-F.col(cp)).cast("double"))


def from_side(cp: Column, white_to_view: Column) -> Column:
    """A score for white as seen by a side."""
    return F.when(white_to_view, cp).otherwise(-cp)


def leaf_label(over: Column, winner_is_root: Column, mate_in: Column, cp: Column, threshold: int = 300) -> Column:
    """1, 0 or -1 for the root's side: the outcome of a finished game, else the sign of a mate, else centipawns beyond the threshold."""
    finished = F.when(winner_is_root.isNull(), 0).when(winner_is_root, 1).otherwise(-1)
    by_score = F.when(cp > threshold, 1).when(cp < -threshold, -1).otherwise(0)
    return F.when(over, finished).when(mate_in.isNotNull(), F.when(mate_in > 0, 1).otherwise(-1)).otherwise(F.coalesce(by_score, F.lit(0))).cast("int")


def is_ancestor(upper: Column, lower: Column) -> Column:
    """Whether a node, named by its moves from the root, stands above another."""
    return (F.size(upper) < F.size(lower)) & (F.slice(lower, F.lit(1), F.size(upper)) == upper)


def ordered_by_score(scores: DataFrame, position: str, value: str, move: str) -> DataFrame:
    """Moves of a position with their place, the best first; ties to the smaller move."""
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(position).orderBy(F.desc(value), move)))


def _candidates(scores: DataFrame, most: int, temperature: float, eps: float) -> DataFrame:
    """The best moves of each position with its entropy and the moves' uncertainty weights, which don't depend on a tree."""
    w = Window.partitionBy("position")
    best = ordered_by_score(scores, "position", "work", "move").filter(F.col("place") <= most)
    e = F.exp((F.col("work") - F.max("work").over(w)) / F.lit(float(temperature)))
    best = best.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    entropy = -F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0)).over(w)
    return best.select("position", "move", "child", "place", "work", "ref", entropy.alias("entropy"), F.count(F.lit(1)).over(w).cast("int").alias("n"))


def width(entropy: Column, n: Column) -> Column:
    """Children to expand: linear in the entropy's share of its maximum, half to even, at least one."""
    share = F.when(n > 1, F.least(F.greatest(entropy / F.ln(n), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.greatest(F.bround(1 + share * (n - 1)).cast("int"), F.lit(1))


def grow(roots: DataFrame, scores: DataFrame, budget: str = "budget", most: int = 5, depth: int = 6, stop_entropy: float = 0.5, temperature: float = 100.0, eps: float = 1e-6) -> DataFrame:
    """(tree, path, position): the lines of each tree with the position at their ends.

    roots: (tree, position, budget). A node is a leaf once its budget is used up, at full depth, or without moves. Below ``stop_entropy``
    only the best line is followed (never at the root); else the width grows with the entropy, and what is left of the budget after this node
    is shared out by uncertainty: the root of the working depth's distance to the reference depth, in deviations of the reference; floors first, then single units to the largest weights.
    """
    table = written(_candidates(scores, most, temperature, eps), "grow-candidates")
    front = roots.select("tree", "position", F.col(budget).cast("long").alias("budget"), F.array().cast("array<string>").alias("path"), F.lit(False).alias("straight"))
    done = None
    for level in range(depth + 1):
        front = written(front, "grow-front")
        if front.isEmpty():
            break
        open_ = front.filter("budget > 0") if level < depth else front.limit(0)
        moves = open_.join(table, "position")
        at_root = F.lit(level == 0)
        straight = F.col("straight") | ((F.col("entropy") < stop_entropy) & ~at_root)
        wide = F.when(straight, 1).otherwise(F.when(at_root, F.col("n")).otherwise(width(F.col("entropy"), F.col("n"))))
        moves = moves.withColumn("_straight", straight).withColumn("_wide", wide).filter(F.col("place") <= F.col("_wide"))
        node = Window.partitionBy("tree", "path")
        spread = F.coalesce(F.stddev_pop("ref").over(node), F.lit(0.0)) + F.lit(eps)
        weight = F.sqrt(F.coalesce(F.abs(F.col("ref") - F.col("work")) / spread, F.lit(0.0)) + F.lit(eps))
        moves = moves.withColumn("_w", weight)
        exact = F.col("_w") / F.sum("_w").over(node) * (F.col("budget") - 1)
        moves = moves.withColumn("_units", F.floor(exact).cast("long"))
        left = F.col("budget") - 1 - F.sum("_units").over(node)
        moves = moves.withColumn("_left", left).withColumn("_rank", F.row_number().over(node.orderBy(F.desc("_w"), "place")))
        units = F.col("_units") + (F.col("_rank") <= F.col("_left")).cast("long")
        share = F.when(F.col("_straight"), F.col("budget") - 1).otherwise(units)
        below = written(moves.select("tree", F.col("child").alias("position"), share.alias("budget"), F.concat("path", F.array("move")).alias("path"), F.col("_straight").alias("straight"), F.col("path").alias("_parent")), "grow-level")
        ends = front.join(below.select("tree", F.col("_parent").alias("path")).distinct(), ["tree", "path"], "left_anti").filter(F.size("path") > 0).select("tree", "path", "position")
        done = ends if done is None else done.unionByName(ends)
        front = below.drop("_parent")
    return done


def lines_in_order(lines: DataFrame, value: str) -> DataFrame:
    """(tree, text): a tree's lines from the worst to the best end, joined by separators; one row a tree, whose size the budget bounds."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.array_join("path", " ").alias("t"))))
    return lines.groupBy("tree").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " <sep> ").alias("text"))


def labelled_trees(lines: DataFrame, ends: DataFrame, threshold: int = 300) -> DataFrame:
    """(tree, root move, value, label): leaves labelled, minimax up to the root's moves (the root's side at even depth).

    ends: (tree, path, cp for the root's side, mate_in, over, winner_is_root). A leaf without a score counts 0.
    """
    leaves = lines.join(ends, ["tree", "path"], "left")
    label = leaf_label(F.coalesce("over", F.lit(False)), F.col("winner_is_root"), F.col("mate_in"), F.col("cp"), threshold)
    rows = leaves.select("tree", "path", F.coalesce(F.col("cp"), F.lit(0.0)).cast("double").alias("value"), label.alias("label"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for d in range(deepest, 1, -1):
        at = rows.filter(F.size("path") == d)
        # the side that chooses among children of depth d moves at depth d - 1: the root's at even depths
        best = F.max if (d - 1) % 2 == 0 else F.min
        up = at.groupBy("tree", F.slice("path", F.lit(1), F.lit(d - 1)).alias("path")).agg(best("value").alias("value"), best("label").alias("label"))
        rows = rows.filter(F.size("path") < d).unionByName(up)
    return rows.select("tree", F.get("path", F.lit(0)).alias("move"), "value", "label")


def slots(positions: DataFrame, position: str, candidates: str, n_lines: str, multiple: int = 16) -> DataFrame:
    """(slot, position, candidate, line): what a generator is asked for, in order, with slots without a position up to a multiple.

    Numbered from counts per range of positions, so no task sees all slots.
    """
    from .batch import numbered

    rows = positions.select(position, F.posexplode(candidates).alias("candidate_no", "candidate"), n_lines)
    rows = rows.withColumn("line", F.explode(F.sequence(F.lit(0), F.col(n_lines) - 1))).drop(n_lines)
    rows = written(numbered(rows, [position, "candidate_no", "line"], "slot"), "slots")
    total = rows.count()
    spark = rows.sparkSession
    pad = spark.range(total, total + (-total % multiple)).select(F.col("id").alias("slot"))
    return rows.unionByName(pad, allowMissingColumns=True)


def regrouped(generated: DataFrame, slots_table: DataFrame, position: str) -> DataFrame:
    """(position, candidate, lines): generated texts by slot, padding dropped, in the order of lines."""
    rows = slots_table.filter(F.col(position).isNotNull()).join(generated, "slot")
    lists = F.array_sort(F.collect_list(F.struct("line", "text")))
    return rows.groupBy(position, "candidate_no", "candidate").agg(F.transform(lists, lambda x: x["text"]).alias("lines"))


def engine_failures(wanted: DataFrame, scores: DataFrame, position: str) -> DataFrame:
    """Wanted positions that have no scores: what an engine failed on."""
    return wanted.select(position).distinct().join(scores.select(position).distinct(), position, "left_anti").withColumn("error", F.lit("no scores"))


def lines_for_budget(moves: Column, depth: int) -> Column:
    """Lines that a budget of moves pays for."""
    return F.floor(moves / F.lit(depth)).cast("int")


def synthesise(roots: DataFrame, scores: DataFrame, leaf_scores: DataFrame, context: str | None = None, breadth: bool = False, **options) -> DataFrame:
    """(tree, text, move, label, value, n_lines): trees grown, labelled, searched by minimax and written as reasoning traces that end in the best move.

    leaf_scores: (position, cp for the root's side, mate_in, over, winner_is_root). Ties between root moves go to the value, then to the smaller move. A root without
    moves has an empty text. ``context``: a column of roots that the trace follows.
    """
    from . import traversals as V
    from . import trees as T

    lines = written(grow(roots, scores, **options), "synthesis-lines")
    ends = lines.join(leaf_scores, "position", "left").drop("position")
    moves = labelled_trees(lines.select("tree", "path"), ends)
    best = moves.groupBy("tree").agg(F.min_by(F.struct("move", "label", "value"), F.struct(-F.col("label"), -F.col("value"), F.col("move"))).alias("b"))
    named = lines.select("tree", "path", F.array_join("path", " ").alias("line"))
    nodes = V.nodes_of(T.visits(named, "tree", "line", "path"), "tree", "line")
    label = leaf_label(F.coalesce("over", F.lit(False)), F.col("winner_is_root"), F.col("mate_in"), F.col("cp"))
    leaves = ends.select("tree", F.array_join("path", " ").alias("prefix"), label.alias("label"))
    text = V.traversal(nodes.join(leaves, ["tree", "prefix"], "left"), "tree", label="label", breadth=breadth, separators=True)
    counts = lines.groupBy("tree").agg(F.count(F.lit(1)).alias("n_lines"))
    out = roots.select("tree", *([F.col(context).alias("_context")] if context else [])).join(best, "tree", "left").join(text, "tree", "left").join(counts, "tree", "left")
    whole = V.trace(F.col("text"), F.col("b.move"), F.col("_context") if context else None)
    return out.select("tree", whole.alias("text"), "b.move", "b.label", "b.value", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
