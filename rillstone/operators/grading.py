"""Grading of played moves: one turn and several, matching, pass@k, centipawn gaps, and the tables evaluations report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import moves as M
from ..functions.notation import is_legal
from .quantiles import exact_quantiles

#: Ways to grade one turn: the move alone, the move if the format holds, all of the player's moves in plain text.
MODES = ("move", "formatted", "plain")


def one_turn(output: Column, targets: Column, mode: str = "move") -> Column:
    """(score, extracted_move, extracted_uci, format_score, first_move_score) of an output; targets: coordinates, the player's at even places."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    first = F.get(targets, F.lit(0))
    if mode == "plain":
        found = M.moves_in(output)
        wanted = F.filter(F.sequence(F.lit(0), F.greatest(F.size(targets), F.lit(1)) - 1), lambda i: i % 2 == 0)
        right = F.forall(wanted, lambda i: F.coalesce(M.to_uci(F.get(found, i)), F.lit("")) == F.get(targets, i))
        move, formatted, score = F.get(found, F.lit(0)), F.lit(0.0), right.cast("double")
    else:
        after = M.move_after_thought(output)
        # without the format, a move anywhere counts; with it, only one after the thought
        move = F.when(after["formatted"], after["move"]).otherwise(F.nullif(M.first_move(output), F.lit("")))
        formatted = after["formatted"].cast("double")
        score = F.coalesce((M.to_uci(move) == first).cast("double"), F.lit(0.0))
        score = score * formatted if mode == "formatted" else score
    uci = F.coalesce(M.to_uci(move), F.lit(""))
    return F.struct(score.alias("score"), F.coalesce(move, F.lit("")).alias("extracted_move"), uci.alias("extracted_uci"), formatted.alias("format_score"), ((uci != "") & F.coalesce(uci == first, F.lit(False))).cast("double").alias("first_move_score"))


def several_turns(output: Column, targets: Column) -> Column:
    """(score, extracted, first_move_score): right if the lists have one length and agree everywhere. A move that doesn't convert keeps its text, a missing one is empty."""
    found = F.transform(M.own_moves(output), lambda m: F.when(m.isNull(), "").otherwise(F.coalesce(M.to_uci(m), m)))
    agree = F.forall(F.zip_with(found, targets, lambda a, b: a.eqNullSafe(b) & (a != "")), lambda x: x)
    first = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
    right = (F.size(found) > 0) & (F.size(found) == F.size(targets)) & F.coalesce(agree, F.lit(False))
    return F.struct(right.cast("double").alias("score"), found.alias("extracted"), ((first != "") & F.coalesce(first == F.get(targets, F.lit(0)), F.lit(False))).cast("double").alias("first_move_score"))


def with_legality(df: DataFrame, fen: str, move: str, out: str = "legal") -> DataFrame:
    """Whether the move can be played in the position; anything that fails is not."""
    return df.withColumn(out, is_legal(F.col(fen), F.col(move)))


def match_accuracy(df: DataFrame, predicted: str, target: str, normalise: bool = True, by: list[str] | None = None) -> DataFrame:
    """match_accuracy, num_matches and num_total; a missing prediction doesn't match."""
    form = M.normal_move if normalise else (lambda c: c)
    hit = F.coalesce(form(F.col(predicted)) == form(F.col(target)), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("match_accuracy"), F.count_if(hit).alias("num_matches"), F.count(F.lit(1)).alias("num_total"))


def legal_accuracy(df: DataFrame, legal: str, by: list[str] | None = None) -> DataFrame:
    hit = F.coalesce(F.col(legal), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("legal_accuracy"), F.count_if(hit).alias("num_legal"), F.count(F.lit(1)).alias("num_total"))


def any_match(df: DataFrame, predictions: str, target: str, normalise: bool = True, by: list[str] | None = None) -> DataFrame:
    """pass_at_k, num_passed and num_total: rows of which any prediction matches; missing ones are passed over."""
    form = M.normal_move if normalise else F.trim
    wanted = form(F.col(target))
    hit = F.coalesce(F.exists(F.filter(predictions, lambda p: p.isNotNull()), lambda p: form(p) == wanted), F.lit(False))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("pass_at_k"), F.count_if(hit).alias("num_passed"), F.count(F.lit(1)).alias("num_total"))


def evaluation(df: DataFrame, predicted: str, target: str, legal: str, formatted: str | None = None, by: list[str] | None = None) -> DataFrame:
    """One row of legality, matching and, for thinking outputs, format; one pass."""
    hit = F.coalesce(M.normal_move(F.col(predicted)) == M.normal_move(F.col(target)), F.lit(False))
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    cols = [share(F.col(legal)).alias("legal_accuracy"), F.count_if(F.col(legal)).alias("num_legal"), share(hit).alias("match_accuracy"), F.count_if(hit).alias("num_matches"), F.count(F.lit(1)).alias("num_total")]
    if formatted:
        cols += [share(F.col(formatted)).alias("format_rate"), F.coalesce(F.avg(F.when(F.col(formatted), hit.cast("double"))), F.lit(0.0)).alias("match_when_formatted")]
    return df.groupBy(*(by or [])).agg(*cols)


def evaluations(spark, table: list[tuple[str, DataFrame, Callable[[DataFrame], DataFrame], int | None]], order: str) -> DataFrame:
    """(prefix/metric, value) of several evaluations: (prefix, rows, evaluator, cap); a cap takes the first rows by order."""
    out = None
    for prefix, rows, evaluator, cap in table:
        row = evaluator(rows.orderBy(order).limit(cap) if cap is not None else rows)
        names = row.columns
        long = row.select(F.explode(F.array(*[F.struct(F.lit(f"{prefix}/{n}").alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
        out = long if out is None else out.unionByName(long)
    return out if out is not None else spark.createDataFrame([], "metric string, value double")


def centipawn_gap(played: DataFrame, scores: DataFrame, position: str, move: str, child: str, cp: str) -> DataFrame:
    """Mean, median and number of max(0, best - played), from the side to move.

    scores: (position, cp from the side to move there) with mates already capped. The score after a move is the child's, negated.
    Moves without a score of either position don't count.
    """
    best = scores.select(F.col(position), F.col(cp).alias("_best"))
    after = scores.select(F.col(position).alias(child), (-F.col(cp)).alias("_after"))
    gap = F.greatest(F.col("_best") - F.col("_after"), F.lit(0)).cast("double")
    rows = played.filter(F.col(move).isNotNull()).join(best, position).join(after, child)
    median = exact_quantiles(rows, gap, [0.5])[0]
    return rows.agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("cp_gap_mean"), F.lit(median or 0.0).alias("cp_gap_median"), F.count(F.lit(1)).alias("num_evaluated"))


def capped_score(cp: Column, mate_in: Column, most: int = 10_000) -> Column:
    """Centipawns; a mate counts ``most`` for whoever gives it."""
    return F.when(mate_in.isNotNull(), F.when(mate_in > 0, most).otherwise(-most)).otherwise(cp)


def mean_by_source(df: DataFrame, source: str, responses: str, grade: Callable[[Column], Column]) -> DataFrame:
    """Each response graded, the mean of a row's grades, then the mean over the rows of a source. Grades stay in the row: no explode."""
    grades = F.transform(responses, lambda r: grade(r).cast("double"))
    mean = F.aggregate(grades, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(responses), F.lit(0))
    return df.select(source, mean.alias("_mean")).groupBy(source).agg(F.avg("_mean").alias("score"), F.count(F.lit(1)).alias("n"))


def metric_names(df: DataFrame, variable: str, metric: str, n: str, core: str = "acc") -> DataFrame:
    """Long validation metrics with a section: val-core for mean, maj and best of the core variable at the largest n, val-aux for the rest."""
    from pyspark.sql.window import Window

    largest = F.max(n).over(Window.partitionBy(variable))
    is_core = (F.col(variable) == core) & F.col(metric).rlike("^(mean|maj|best)@") & (F.col(n) == largest)
    return df.withColumn("section", F.when(is_core, "val-core").otherwise("val-aux"))


def constant_per_group(df: DataFrame, group: str, label: str, metrics: list[str]) -> DataFrame:
    """Means of the groups' means; a group with unlike labels fails the job."""
    per = df.groupBy(group).agg(F.count_distinct(label).alias("_labels"), *[F.avg(m).alias(m) for m in metrics])
    ok = F.when(F.col("_labels") <= 1, F.lit(0.0)).otherwise(F.raise_error(F.concat(F.lit("labels differ in group "), F.col(group).cast("string"))).cast("double"))
    return per.agg(*[F.avg(F.col(m) + ok).alias(m) for m in metrics])


def safe(score: Column, otherwise: float = 0.0) -> Column:
    """A grade that is missing or not a number counts ``otherwise``: one bad row never zeroes others."""
    return F.coalesce(F.nanvl(score, F.lit(None).cast("double")), F.lit(float(otherwise)))
