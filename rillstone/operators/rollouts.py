"""Rollout rows: length filters, padding to a batch, segments, step rewards, accuracy by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def short_prompts(df: DataFrame, ids: str, most: int) -> DataFrame:
    """Rows whose token list has at most ``most`` ids; a missing list counts as too long."""
    return df.filter(F.coalesce(F.size(ids) <= most, F.lit(False)))


def collated(df: DataFrame, batch: str, ids: str, labels: str, pad: int = 0, ignored: int = -100) -> DataFrame:
    """Ids and labels padded to the longest row of their batch, with the attention mask."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_longest"))
    rows = df.join(longest, batch)
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v).cast("long"), F.col("_longest") - F.size(c)))
    mask = F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("_longest") - F.size(ids)))
    return rows.withColumn("attention_mask", mask).withColumn(ids, fill(ids, pad)).withColumn(labels, fill(labels, ignored)).drop("_longest")


def segments(text: Column) -> Column:
    """The segments that end with a call to the environment; what follows the last call is ignored."""
    return F.transform(F.slice(F.split(text, X.CALL), F.lit(1), F.size(F.split(text, X.CALL)) - 1), lambda s: F.trim(s))


def segment_moves(text: Column) -> Column:
    """Of each segment the first word after the thinking, else its last word."""
    after = lambda s: F.when(s.contains(X.CLOSE), F.try_element_at(F.split(F.trim(F.substring_index(s, X.CLOSE, -1)), r"\s+"), F.lit(1))).otherwise(F.try_element_at(F.split(s, r"\s+"), F.lit(-1)))
    return F.transform(segments(text), after)


def media_parts(content: Column) -> Column:
    """Content split at image and video marks into (kind, text), empty texts dropped."""
    marked = F.split(F.regexp_replace(content, r"(<image>|<video>)", "\u0001$1\u0001"), "\u0001")
    typed = F.transform(marked, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("kind"), p.alias("text")))
    return F.filter(typed, lambda x: x["text"] != "")


def step_rewards(ends: Column, rewards: Column, length: Column) -> Column:
    """A list of ``length`` with each reward at its step's last token."""
    at = lambda i: F.array_position(ends, i)
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(at(i) > 0, F.get(rewards, at(i).cast("int") - 1)).otherwise(0.0))


def accuracy_by_depth(df: DataFrame, predicted: str, target: str) -> DataFrame:
    """Share of right moves at each depth; a depth that only the target has counts as wrong."""
    depth = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(target) - 1), lambda i: F.get(F.col(predicted), i).eqNullSafe(F.get(F.col(target), i))))
    rows = df.filter(F.size(target) > 0).select(depth.alias("depth", "right"))
    return rows.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"))


def failure_reason(has_format: Column, parsed: Column, legal: Column, right: Column) -> Column:
    return F.when(right, "none").when(~has_format, "format").when(~parsed, "no_move").when(~legal, "illegal").otherwise("wrong_move")
