"""Joins of two streams: rewards that arrive after their rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_rewards(rollouts: DataFrame, rewards: DataFrame, key: str, at: str, reward_at: str, late: str, patience: str) -> DataFrame:
    """Each rollout with the rewards dated within ``patience`` from it on, a row for each; without one, a row of nulls once its time is over.

    Both sides have a watermark, so state holds a rollout until the watermark is past its patience, and a reward until no rollout can want it any more.
    A rollout without a key or time waits for nothing: it has no row. Rows behind the watermark are dropped. The columns of ``rewards`` come with ``key`` named ``reward_<key>``.
    """
    left = rollouts.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late)
    right = rewards.filter(F.col(key).isNotNull() & F.col(reward_at).isNotNull()).withColumnRenamed(key, f"reward_{key}").withWatermark(reward_at, late)
    when = (F.col(reward_at) >= F.col(at)) & (F.col(reward_at) <= F.col(at) + F.expr(f"INTERVAL {patience}"))
    return left.join(right, (F.col(key) == F.col(f"reward_{key}")) & when, "left_outer")
