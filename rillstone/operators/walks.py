"""Sampled rollouts: first moves drawn without replacement, then seeded random walks over a table of scored moves.

The policy of a position is the softmax of its moves' scores. It is laid out once as intervals of whole numbers below 2^48, so a draw is the
hash of a seed and a walk's keys, found by an equi-join on (position, one of 32 bins) and a comparison inside the bin: a walk meets the few
moves of its bin, a position that holds a third of all walks is spread over 32 keys, and no row is multiplied by a position's moves.
All walks take a step per round, so rollouts cost as many joins as they are deep, however many run at once; the policies are shuffled once for all rounds. Lost tasks draw the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..sources.scratch import discard, written
from .sampling import gumbel_sample, hashed

#: Weights relative to a position's best move, in whole units; each move keeps at least one.
UNITS = 1 << 30
#: A draw is below 2^48; its upper 5 bits are the bin.
SPAN, SHIFT = 1 << 48, 43
#: Walks of a root are numbered in blocks, so that no single row holds them all.
BLOCK = 1024


def moves_of(scores: DataFrame) -> DataFrame:
    """(position, move, child, score), one row a move: of repeated rows the highest score, then the largest child. Rows without a position, a move or a finite score are no moves."""
    known = F.col("score").cast("double")
    rows = scores.select("position", "move", "child", known.alias("score")).filter("position IS NOT NULL AND move IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    rows = rows.filter(F.abs("score") < float("inf"))
    best = F.max(F.struct("score", "child")).alias("_b")
    return rows.groupBy("position", "move").agg(best).select("position", "move", "_b.child", "_b.score")


def intervals(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(position, bin, low, high, move, child): each move's share of 0 to 2^48 in the order of (range, hash, move), a row for each bin that it touches.

    Two-level: a position's moves are dealt into 4,096 ranges by hash; maxima and sums per range meet in a window of at most so many rows a position, and only a range is sorted.
    """
    return _laid_out(moves_of(scores), temperature)


def _laid_out(moves: DataFrame, temperature: float) -> DataFrame:
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    mark = F.md5(F.col("move").cast("string").cast("binary"))
    rows = moves.withColumn("_mark", mark).withColumn("_range", F.substring("_mark", 1, 3))
    place = Window.partitionBy("position")
    peaks = rows.groupBy("position", "_range").agg(F.max("score").alias("_m")).select("position", "_range", F.max("_m").over(place).alias("_peak"))
    share = F.exp((F.col("score") - F.col("_peak")) / F.lit(float(temperature)))
    rows = rows.join(peaks, ["position", "_range"]).withColumn("_w", F.greatest(F.floor(share * F.lit(float(UNITS))), F.lit(1)).cast("decimal(38,0)"))
    sums = rows.groupBy("position", "_range").agg(F.sum("_w").cast("decimal(38,0)").alias("_part"))
    before = F.sum("_part").over(place.orderBy("_range")) - F.col("_part")
    sums = sums.select("position", "_range", before.alias("_before"), F.sum("_part").over(place).alias("_total"))
    inner = F.sum("_w").over(Window.partitionBy("position", "_range").orderBy("_mark", "move").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_to", inner).join(sums, ["position", "_range"])
    # whole shares of the span: below 2^63 units in all, products stay within 38 digits
    at = lambda c: F.expr(f"CAST(CAST(({c}) AS DECIMAL(19,0)) * CAST({SPAN} AS DECIMAL(18,0)) div _total AS BIGINT)")
    rows = rows.select("position", at("_before + _to - _w").alias("low"), at("_before + _to").alias("high"), "move", "child").filter("high > low")
    bins = F.sequence(F.shiftright("low", SHIFT), F.shiftright(F.col("high") - 1, SHIFT))
    return rows.select("position", F.explode(bins).alias("bin"), "low", "high", "move", "child")


def candidates(roots: DataFrame, scores: DataFrame, n: int, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """(tree, draw, move, position): up to n first moves of each root, drawn without replacement, in the order drawn; a root with fewer moves gives all of them.

    roots: (tree, position), one row a tree. Perturbed scores are cut to the n largest before the shuffle.
    """
    drawn = gumbel_sample(roots.select("tree", "position").join(moves_of(scores), "position"), "tree", "move", "score", n, temperature, seed)
    return drawn.select("tree", "draw", "move", F.col("child").alias("position"))


def walks(starts: DataFrame, laid: DataFrame, keys: list[str], depth: int, seed: int = 0) -> DataFrame:
    """(keys, step, move, position): the steps of walks of at most ``depth`` moves, the position after each.

    starts: (keys, position), one row a walk. laid: the table of ``intervals``. A walk ends in a position without moves, or in none; walks that can't start have no rows.
    """
    done, front = [], starts.select(*keys, "position")
    if depth > 1:  # dealt once for all rounds, which shuffle walks alone; a lost executor's part is read and dealt again
        laid = laid.repartition(int(laid.sparkSession.conf.get("spark.sql.shuffle.partitions")), "position", "bin").persist(StorageLevel.DISK_ONLY)
    for step in range(1, depth + 1):
        point = hashed(seed, *keys, F.lit(step))
        front = front.filter("position IS NOT NULL").withColumn("_at", point).withColumn("bin", F.shiftright("_at", SHIFT))
        hit = front.join(laid, ["position", "bin"]).filter("_at >= low AND _at < high")
        taken = written(hit.select(*keys, F.lit(step).alias("step"), "move", F.col("child").alias("position")), "walk-step")
        if taken.isEmpty():
            discard(taken)
            break
        done.append(taken)
        front = taken.select(*keys, "position")
    if depth > 1:
        laid.unpersist()
    if not done:
        none = starts.select(*keys, "position").limit(0)
        return none.join(laid.select("position", "move", "child").limit(0), "position").select(*keys, F.lit(1).alias("step"), "move", F.col("child").alias("position"))
    out = done[0]
    for taken in done[1:]:
        out = out.unionByName(taken)
    return out


def rollouts(roots: DataFrame, scores: DataFrame, n_candidates: int, n_walks: int | str, depth: int, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """(tree, draw, walk, step, move, position): ``n_walks`` walks for each first move of each root, each of at most ``depth`` moves, the first included (step 0).

    roots: (tree, position), one row a tree; rows without either are left out, of a repeated tree the smallest position counts. n_walks: a number, or a column of roots;
    null or below 1 gives none. Walks are drawn with replacement, so they may agree: they meet in a prefix tree. A root without moves gives no rows.
    """
    if depth < 1 or n_candidates < 1:
        raise ValueError("depth and candidates must be at least 1")
    wanted = F.col(n_walks) if isinstance(n_walks, str) else F.lit(n_walks)
    known = roots.filter("tree IS NOT NULL AND position IS NOT NULL").select("tree", F.struct("position", wanted.cast("long").alias("n")).alias("_r"))
    known = known.groupBy("tree").agg(F.min("_r").alias("_r")).select("tree", "_r.position", F.col("_r.n").alias("_n")).filter("_n > 0")
    moves = written(moves_of(scores), "walk-moves")
    laid = written(_laid_out(moves, temperature), "walk-intervals")
    first = gumbel_sample(known.join(moves, "position"), "tree", "move", "score", n_candidates, temperature, seed)
    blocks = first.drop("position").withColumnRenamed("child", "position").withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK).cast("long"))))
    end = F.least(F.col("_n"), (F.col("_block") + 1) * BLOCK) - 1
    starts = blocks.withColumn("walk", F.explode(F.sequence(F.col("_block") * BLOCK, end)))
    starts = written(starts.select("tree", "draw", "walk", F.lit(0).alias("step"), "move", "position"), "walk-starts")
    discard(moves)
    return starts.unionByName(walks(starts, laid, ["tree", "draw", "walk"], depth - 1, seed))


def lines(steps: DataFrame) -> DataFrame:
    """(tree, draw, walk, path): the moves of each walk in order, a row a walk, whose size the depth bounds."""
    return steps.groupBy("tree", "draw", "walk").agg(F.array_sort(F.collect_list(F.struct("step", "move"))).alias("_s")).select("tree", "draw", "walk", F.col("_s.move").alias("path"))
