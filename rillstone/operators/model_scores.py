"""Evaluation of a model's probabilities: losses over tokens, policies over legal moves, divergence from an engine's scores.

Token log-probabilities and engine scores are input tables; nothing is generated here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def held_out(tokens: DataFrame, loss: str, entropy: str, by: list[str] | None = None) -> DataFrame:
    """Mean loss and mean token entropy."""
    return tokens.groupBy(*(by or [])).agg(F.avg(loss).alias("loss"), F.avg(entropy).alias("entropy"), F.count(F.lit(1)).alias("n_tokens"))


def first_positions(df: DataFrame, order: str, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` rows by order among those whose keys aren't NULL."""
    return df.dropna(subset=keys).orderBy(order).limit(most)


def move_policy(tokens: DataFrame, position: list[str], move: list[str], log_prob: str) -> DataFrame:
    """(position, move, p): a move's token log-probabilities are summed, and a softmax runs over the moves of a position."""
    moves = tokens.groupBy(*position, *move).agg(F.sum(log_prob).alias("_l"))
    w = Window.partitionBy(*position)
    e = F.exp(F.col("_l") - F.max("_l").over(w))
    return moves.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_l", "_e")


def policy_entropy(policy: DataFrame, position: list[str], tops: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Means over positions of the entropy (with 1e-9 inside the logarithm) and of the mass of the likeliest moves."""
    w = Window.partitionBy(*position).orderBy(F.desc("p"))
    rows = policy.withColumn("_k", F.row_number().over(w))
    per = rows.groupBy(*position).agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-9))).alias("entropy"), *[F.sum(F.when(F.col("_k") <= k, F.col("p"))).alias(f"top{k}_mass") for k in tops])
    return per.agg(F.avg("entropy").alias("entropy"), *[F.avg(f"top{k}_mass").alias(f"top{k}_mass") for k in tops], F.count(F.lit(1)).alias("n_positions"))


def engine_divergence(policy: DataFrame, scores: DataFrame, position: list[str], move: list[str], cp: str, temperature: float = 100.0) -> DataFrame:
    """The mean over positions of KL(policy || softmax of the engine's scores) / ln(number of moves); positions with one move don't count."""
    w = Window.partitionBy(*position)
    rows = policy.join(scores.select(*position, *move, cp), [*position, *move])
    e = F.exp((F.col(cp) - F.max(cp).over(w)) / F.lit(float(temperature)))
    rows = rows.withColumn("_e", e).withColumn("_q", F.col("_e") / F.sum("_e").over(w)).withColumn("_p", F.col("p") / F.sum("p").over(w))
    term = F.when(F.col("_p") > 1e-12, F.col("_p") * F.ln(F.col("_p") / F.greatest(F.col("_q"), F.lit(1e-12)))).otherwise(0.0)
    per = rows.groupBy(*position).agg(F.sum(term).alias("kl"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return per.select((F.col("kl") / F.ln("n")).alias("x")).agg(F.avg("x").alias("normalised_kl"), F.count(F.lit(1)).alias("n_positions"))


def scored_turns(lines: DataFrame, scores: DataFrame, puzzle: str, moves: str) -> DataFrame:
    """One row per turn of the model: the position it stands in, the true move, and the scores of its legal moves.

    lines: (puzzle, fen, array of true moves, model and reply in turn). scores: (puzzle, turn, move, log_prob). The board is replayed
    once per line, in Arrow batches; the scores are joined.
    """
    from ..functions.notation import positions_along

    at = F.arrays_zip(positions_along("fen", moves).alias("fen"), F.col(moves).alias("move"))
    turns = lines.select(puzzle, F.posexplode(at).alias("ply", "x")).filter("ply % 2 = 0")
    turns = turns.select(puzzle, (F.col("ply") / 2).cast("int").alias("turn"), F.col("x.fen").alias("fen"), F.col("x.move").alias("truth"))
    legal = scores.groupBy(puzzle, "turn").agg(F.array_sort(F.collect_list(F.struct("move", "log_prob"))).alias("legal"))
    return turns.join(legal, [puzzle, "turn"], "left")
