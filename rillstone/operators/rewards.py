"""Grading of rollouts: routing by source, weighted parts, length penalties, placement on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def route(source: Column, rules: dict[str, Column], otherwise: Column | None = None) -> Column:
    """The rule of the row's source; without a default an unknown source fails the job."""
    out = otherwise if otherwise is not None else F.raise_error(F.concat(F.lit("no reward for source "), F.coalesce(source, F.lit("NULL")))).cast("double")
    for name, rule in rules.items():
        out = F.when(source == name, rule).otherwise(out)
    return out


def single_turn(output: Column, target: Column, need_format: bool = True) -> Column:
    """1.0 if the first move after the closing tag is the target; a bad format scores 0."""
    move = F.try_element_at(F.split(F.trim(X.answer_part(output)), r"\s+"), F.lit(1))
    right = (F.coalesce(X.lan_to_uci(move), F.lit("")) == target) & (target != "")
    return (right & X.well_formed(output) if need_format else right).cast("double")


def multi_turn(extracted: Column, targets: Column) -> Column:
    """1.0 if both lists have the same length and agree at every place; failed conversions keep their raw text."""
    same = F.zip_with(extracted, targets, lambda a, b: F.coalesce(X.lan_to_uci(a), a).eqNullSafe(b))
    return ((F.size(extracted) == F.size(targets)) & F.forall(same, lambda x: x)).cast("double")


def exact_answer(output: Column, gold: Column, score: float = 1.0, format_score: float = 0.0) -> Column:
    """Score for the last answer's exact match; quartered beyond ten answer tags."""
    tags = F.size(F.split(output, "</answer>")) - 1
    base = F.when(X.exact_match(X.last_answer(output), gold), score).otherwise(format_score)
    return F.when(X.last_answer(output).isNull(), 0.0).when(tags > 10, base / 4).otherwise(base)


def number_answer(output: Column, gold: Column, strict: bool = True) -> Column:
    n = X.strict_number(output) if strict else X.flexible_number(output)
    return F.coalesce((n == gold).cast("double"), F.lit(0.0))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """min(-(excess over most - buffer) / buffer * factor, 0)."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def place_on_last_token(df: DataFrame, score: str, mask: str, out: str = "token_rewards") -> DataFrame:
    """An array as long as the mask: the score at the last valid token, 0 elsewhere."""
    last = F.size(mask) - F.array_position(F.reverse(mask), 1)
    return df.withColumn(out, F.transform(mask, lambda m, i: F.when((i == last) & (m == 1), F.col(score)).otherwise(0.0)))
